"""Relational operators of the geocoder."""
