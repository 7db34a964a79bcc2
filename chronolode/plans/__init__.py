"""Inputs shaped from the given tables, and the catalog of queries."""
