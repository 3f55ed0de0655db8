"""Operators on streams of frames."""
