"""Parchment: a PySpark-native document-intelligence analytics engine."""

__version__ = "0.1.0"
