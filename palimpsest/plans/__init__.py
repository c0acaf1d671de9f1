"""Palimpsest: plans."""
