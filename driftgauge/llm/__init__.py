"""Operators of a training-data pipeline: text in tables, one module per operator."""
