"""lamina: MergeTree-style tables and training-data operators on Spark SQL."""
