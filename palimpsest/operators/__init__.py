"""Palimpsest: operators."""
