"""Readers of sites and stores of releases."""
