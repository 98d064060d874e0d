"""Operators on tables of facts."""
