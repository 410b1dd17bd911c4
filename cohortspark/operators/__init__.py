"""Operators on tables: alignment, unit collapse, releases and what is derived from them."""
