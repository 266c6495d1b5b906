"""Corpus operators for training-data pipelines. Nothing outside this subpackage imports it."""
