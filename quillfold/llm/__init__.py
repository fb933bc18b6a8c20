"""Operators for preparing training data for language models, and their registered queries."""
