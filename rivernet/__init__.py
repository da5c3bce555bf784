"""River-network routing and training-data preparation as Spark jobs."""
