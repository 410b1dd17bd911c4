"""Releases kept up to date over streams."""
