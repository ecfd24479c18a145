"""Text-curation and analytics operators for Spark, built on the DataFrame API."""

__version__ = "0.1.0"
