"""Structured Streaming forms of the daily load, the hourly roll-up and the dry-spell count."""
