"""Relational operators: each is a ``DataFrame -> DataFrame`` function."""
