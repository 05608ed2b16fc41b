"""Lodestrata plans."""
