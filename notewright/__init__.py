"""A document-to-knowledge-base engine written as PySpark DataFrame plans."""
