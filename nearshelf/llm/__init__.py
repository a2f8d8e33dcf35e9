"""Operators for preparing training data, one module each; queries.py registers them."""
