"""Composite plans: whole records from documents."""
