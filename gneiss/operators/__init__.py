"""Relational operators of the recovery pipeline, each a DataFrame -> DataFrame function."""
