"""Palimpsest: functions."""
