"""Relational operators of the georeferencing engine."""
