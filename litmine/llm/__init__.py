"""Operators for large training-data pipelines; nothing else in litmine imports them."""
