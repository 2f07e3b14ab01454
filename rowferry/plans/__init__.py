"""Whole runs: read, convert, select, write, and one row of history."""
