"""Operators for large training-data pipelines. Nothing else in quillgraph imports this package."""
