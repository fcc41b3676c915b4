"""Joins, aggregates, sampling, weights, scoring and training over sample tables."""
