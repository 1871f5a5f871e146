"""Lodelens: search, repository analytics and data preparation as Spark DataFrame pipelines."""
