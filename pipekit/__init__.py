"""Data pipelines and data quality as composable PySpark operators."""

__version__ = "0.1.0"
