"""Incremental variants over file streams."""
