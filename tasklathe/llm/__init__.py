"""Operators for training data; optional, nothing outside imports it."""
