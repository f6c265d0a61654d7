"""Queries over the bound tables, with their SQL twins."""
