"""Spark column expressions for text, scoring and vectors."""
