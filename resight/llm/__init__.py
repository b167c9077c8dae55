"""Operators for training-data pipelines; see queries.py for how they are registered."""
