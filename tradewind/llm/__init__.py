"""Operators for training-data pipelines over web pages, documents and vectors."""
