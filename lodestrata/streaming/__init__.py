"""Lodestrata streaming."""
