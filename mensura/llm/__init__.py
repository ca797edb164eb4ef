"""Operators for training-data pipelines: text, vectors, urls, conversations."""
