"""Derived input tables and the query list."""
