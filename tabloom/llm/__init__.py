"""Operators for text and training-data problems; nothing outside imports this package."""
