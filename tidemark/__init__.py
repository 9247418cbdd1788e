"""tidemark: market-series analytics as Spark DataFrame plans."""
