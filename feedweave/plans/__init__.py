"""Whole documents: parsing and flat views."""
