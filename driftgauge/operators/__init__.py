"""Distributed operators: DataFrame in, DataFrame out."""
