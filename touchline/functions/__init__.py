"""Column expressions: exact rounding, dates, match metrics."""
