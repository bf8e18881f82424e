"""Whole plans: linkage from records to decisions."""
