"""Loomline: a PySpark-native engine for multimodal event timelines."""

__version__ = "0.1.0"
