"""Business-registry filings and crawled pages, turned into qualified company records with Spark."""
