"""Millrace: document ingestion analytics as Spark DataFrame transformations."""
