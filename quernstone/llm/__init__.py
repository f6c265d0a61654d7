"""Training-data operators: mixing, quality, fingerprints, deduplication, sharding, tokenising and scoring of documents.

Nothing else in the library imports this subpackage. Every operator takes a DataFrame and column names and returns a
DataFrame; each module's docstring says what it gives for nulls, empty texts, ties, repeated rows, empty tables and
clashing column names.
"""
