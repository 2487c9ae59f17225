"""Queries, their oracles and whole runs."""
