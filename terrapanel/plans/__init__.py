"""Queries over the driver tables, by inventory id."""
