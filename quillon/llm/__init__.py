"""Operators for preparing language-model training data, on Spark DataFrames.

Nothing outside this subpackage imports it, so it can be removed without touching the panel engine.
"""
