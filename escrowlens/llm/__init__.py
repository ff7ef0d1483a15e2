"""Operators for preparing training text: dedup, fingerprints, language, quality,
mixing, tokenising and web archives.

Nothing else in the library imports this package.  Each operator takes
DataFrames and returns DataFrames; ``queries`` holds the thin registered
queries over the driver's tables.
"""
