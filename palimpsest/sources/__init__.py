"""Palimpsest: sources."""
