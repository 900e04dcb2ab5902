"""Operators on DataFrames: words, morphology, duplicates, splits, metrics and models."""
