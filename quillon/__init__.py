"""Screening analytics over product-declaration records, written as Spark plans."""

__version__ = "0.1.0"
