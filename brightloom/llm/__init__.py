"""Operators for preparing text and record corpora for model training. Nothing else in the library imports this."""
