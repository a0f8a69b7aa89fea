"""Operators for preparing text and speech corpora for model training."""
