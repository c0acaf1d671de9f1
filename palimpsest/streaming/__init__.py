"""Palimpsest: streaming."""
