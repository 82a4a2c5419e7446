"""Readers of document trees, captures and live tables."""
