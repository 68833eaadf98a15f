"""Reports: each builds a lazy DataFrame over the tables."""
