"""Tessera: a PySpark-native engine for analysing document corpora."""

__version__ = "0.1.0"
