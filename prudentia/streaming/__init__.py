"""Incremental pick-up of newly published files."""
