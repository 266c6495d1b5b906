"""Readers and writers of evidence files."""
