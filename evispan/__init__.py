"""Evidence selection, footprint analytics and corpus maintenance on Spark."""
