"""Relational operators over evidence tables."""
