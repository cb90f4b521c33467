"""Operators over source objects, pages and elements."""
