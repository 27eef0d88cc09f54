"""Destinations of changes: snapshots, statements, logs; fan-out to several with isolation."""
