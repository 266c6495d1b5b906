"""Stateful forms: flow assembly and the restoring of streamed answers."""
