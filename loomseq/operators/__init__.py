"""Relational operators on sequences."""
