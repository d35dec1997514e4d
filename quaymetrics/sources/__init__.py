"""Readers, writers and table summaries."""
