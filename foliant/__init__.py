"""foliant: a Spark-first document index, boolean retrieval engine and corpus toolkit."""
