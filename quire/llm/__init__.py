"""Operators for building language-model training data at scale."""
