"""Readers and writers: tables, recordings, map extracts."""
