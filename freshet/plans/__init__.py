"""Whole loads: landed files to tables."""
