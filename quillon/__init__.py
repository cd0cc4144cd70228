"""Quillon: a PySpark-native engine for relational and time-series analytics."""
