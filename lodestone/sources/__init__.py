"""Catalogue tables, configuration stores and the adapter of the benchmark tables."""
