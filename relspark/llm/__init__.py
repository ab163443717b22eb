"""Operators for preparing language-model training data.

Every operator is a plain function from DataFrames to a DataFrame. Nothing outside this
subpackage imports it, so the folder can be removed without touching the algebra engine.
"""
