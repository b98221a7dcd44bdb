"""Layouts, indexes and joins."""
