"""Whole jobs: one label, one pack, recognised lines."""
