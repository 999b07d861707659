"""Operators for training-data pipelines over a table of texts. Nothing else in the library imports this subpackage."""
