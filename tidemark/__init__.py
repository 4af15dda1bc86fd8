"""tidemark: ordered, updatable datasets and restartable ordered aggregation on Spark."""
