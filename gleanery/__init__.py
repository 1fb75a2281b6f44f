"""gleanery: Spark DataFrame programs for web-page ETL, hybrid retrieval and retrieval evaluation."""

__version__ = "0.1.0"
