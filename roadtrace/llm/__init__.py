"""Operators for preparing training text: dedup, joins, scans, rules, tokens, language.

Nothing outside this package imports it.
"""
