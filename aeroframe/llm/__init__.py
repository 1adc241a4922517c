"""Operators for preparing training text: extraction, rules, duplicates, leaks, personal data, mixing, sharding, token files."""
