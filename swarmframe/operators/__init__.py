"""Operators on tables of points and bonds."""
