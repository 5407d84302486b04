"""Relational, text, retrieval and maintenance operators."""
