"""Registered queries over the driver tables, by family, with their SQL."""
