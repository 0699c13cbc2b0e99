"""Column functions: hashing, G functions, key and value text."""
