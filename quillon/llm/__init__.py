"""Operators of a training-data pipeline over text, embedding and url tables."""
