"""Readers, writers and the conventions of their layout."""
