"""Relational operators over the data model."""
