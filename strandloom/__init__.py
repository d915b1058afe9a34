"""strandloom: a Spark-first engine for sequence k-mers, LSH words and read embeddings."""

__version__ = "0.1.0"
