"""Operators on evidence tables: validation, joins, episodes, derivations, reports, detection, masking."""
