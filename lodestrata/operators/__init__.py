"""Lodestrata operators."""
