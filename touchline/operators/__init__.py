"""Building blocks between the raw feed and the reports."""
