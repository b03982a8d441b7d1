"""Operators on record tables, as functions from DataFrame to DataFrame."""
