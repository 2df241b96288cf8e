"""Logical queries and results, and the parsing of request parameters."""
