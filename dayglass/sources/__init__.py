"""Readers and writers: raw logs, keyed tables, feature runs, model tables."""
