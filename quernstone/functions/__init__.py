"""Column functions: hashing, text, vectors."""
