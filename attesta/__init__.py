"""Document-integrity analytics as PySpark DataFrame pipelines."""
