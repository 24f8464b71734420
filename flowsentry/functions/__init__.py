"""Column functions: decoding, scalars, pattern matching."""
