"""Evidence retrieval and corpus analytics on Spark."""
