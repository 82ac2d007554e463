"""Operators for preparing training data: one module each, all on Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
