"""Whole-panel extraction: positioned text lines to typed field evidence."""
