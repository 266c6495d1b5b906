"""Ledgerline: egress accountability and corpus processing on PySpark."""
