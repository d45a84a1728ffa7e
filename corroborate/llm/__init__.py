"""Operators for large training-text pipelines, with their registered queries."""
