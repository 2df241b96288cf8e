"""Scalar functions as Column builders, most with a plain Python twin for single values."""
