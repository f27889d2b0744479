"""Whole comparisons, the command line, and the query catalogue."""
