"""Whole queries over the tables, and their SQL."""
