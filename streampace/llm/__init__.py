"""Operators for preparing training data from text. Nothing else in the library imports them."""
