"""Whole detection runs."""
