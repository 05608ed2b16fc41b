"""Lodestrata sources."""
