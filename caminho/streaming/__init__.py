"""Geocoding of streams."""
