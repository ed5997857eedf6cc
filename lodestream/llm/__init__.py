"""Operators for training-data pipelines over the ``documents`` family of tables."""
