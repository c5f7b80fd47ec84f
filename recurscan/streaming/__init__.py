"""The cascade over files that arrive."""
