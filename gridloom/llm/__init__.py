"""Operators for preparing language-model training data (ten operators, one module each)."""
