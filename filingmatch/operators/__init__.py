"""Jobs over whole tables: DataFrame in, DataFrame out."""
