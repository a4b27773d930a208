"""Folioscope: property-graph, full-text and training-data analytics on PySpark."""

__version__ = "0.1.0"
