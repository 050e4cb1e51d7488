"""Extraction rules: columns over the nodes of a document."""
