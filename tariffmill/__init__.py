"""Spark jobs that turn a corpus of extracted hotel contracts into clean, checked, import-ready tables."""

__version__ = "0.1.0"
