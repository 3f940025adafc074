"""Operators of a training-data pipeline: packing, similarity joins, filters, mixing, chat formatting."""
