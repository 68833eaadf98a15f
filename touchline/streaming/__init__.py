"""Scheduled runs as a file stream."""
