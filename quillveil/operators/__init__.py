"""Operators on DataFrames of documents, pages and entities."""
