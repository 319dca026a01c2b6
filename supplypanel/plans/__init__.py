"""Whole reports and how they are stored."""
