"""Scalar functions: columns in, columns out."""
