"""Operators over training text: scoring, privacy, mixing, quality, duplicates, languages, leaks."""
