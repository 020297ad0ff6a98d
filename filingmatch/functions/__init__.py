"""Column functions: everything here is a Spark expression and stays inside the JVM."""
