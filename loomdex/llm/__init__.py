"""Operators for training data made from web text. Nothing outside this package imports it."""
