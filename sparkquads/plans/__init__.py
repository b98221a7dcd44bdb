"""Patterns and the choice of an access path."""
