"""Operators over text for training data; nothing outside this package imports it."""
