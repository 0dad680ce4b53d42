"""Expressions: geography, similarity, standardization."""
