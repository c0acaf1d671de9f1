"""Palimpsest: wiki-style content analytics on Spark DataFrames."""
