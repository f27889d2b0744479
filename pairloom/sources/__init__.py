"""Readers: folders, delimited text, spreadsheets, stored results."""
