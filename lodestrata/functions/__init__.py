"""Lodestrata functions."""
