"""Column functions: columns in, columns out."""
