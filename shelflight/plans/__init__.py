"""Whole runs over an inventory table."""
