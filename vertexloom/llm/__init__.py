"""Operators for preparing training data from a document corpus."""
