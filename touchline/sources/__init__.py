"""Landed feed files, the table store, and dated league snapshots."""
