"""Readers and file access."""
