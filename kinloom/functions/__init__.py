"""Column functions: text normalisation and similarity."""
