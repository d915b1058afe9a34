"""Whole queries over the driver's tables, and the same in SQL."""
