"""Operators on texts for training data. Nothing outside this package imports it."""
