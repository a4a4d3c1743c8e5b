"""Operators for training data: scoring, similarity, capping, mixing, leaks, reading level."""
