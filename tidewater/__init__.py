"""Spark jobs for governing and analysing user-item event data."""
