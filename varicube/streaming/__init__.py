"""Incremental execution of the category counts."""
