"""A PySpark library for dataset curation, detection evaluation, tracking and training-data pipelines."""
