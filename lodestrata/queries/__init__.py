"""Lodestrata queries."""
