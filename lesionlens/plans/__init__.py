"""Fixtures, whole analyses and the query catalogue."""
