"""Operators for preparing training text and near-duplicate detection. Nothing else in the library imports this."""
