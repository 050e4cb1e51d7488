"""Streams of documents and entries."""
