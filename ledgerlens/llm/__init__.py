"""Operators for large-scale training-data pipelines. Nothing else imports this package."""
