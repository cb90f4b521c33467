"""Queries over the operators, and their SQL."""
