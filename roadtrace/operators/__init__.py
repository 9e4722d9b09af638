"""Relational, window, join and graph operators as DataFrame transformations."""
