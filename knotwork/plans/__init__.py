"""Composed queries over graphs, and the catalogue of named ones."""
