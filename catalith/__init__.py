"""Catalith: a schema-context and data-processing engine on PySpark."""

__version__ = "0.1.0"
