"""Document similarity on Spark: ingest, index, search, compare, evaluate."""
