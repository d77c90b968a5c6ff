"""Operators on text and vectors for training data. Nothing else in the package imports this subpackage."""
