"""Operators for preparing language-model training data (problems 1 and 3 to 10)."""
