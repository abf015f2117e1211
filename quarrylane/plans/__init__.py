"""Queries over the supplied tables."""
