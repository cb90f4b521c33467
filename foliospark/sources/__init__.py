"""Producers of source objects."""
