"""Operators of a training-data pipeline: quality, duplicates, leaks, tokens, personal data, page text.

Every operator takes a DataFrame and the names of the columns it works on, ignores all others (so clashing names are
harmless) and returns one row per input row. The rest of the library does not import this package.
"""
