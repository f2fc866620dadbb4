"""Incremental versions of the activity counts."""
