"""Keyed stateful operators for live and batch input."""
