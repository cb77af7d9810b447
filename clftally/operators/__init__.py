"""Operators: every function takes a DataFrame and returns one, lazily."""
