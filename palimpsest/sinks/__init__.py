"""Palimpsest: sinks."""
