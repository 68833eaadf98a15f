"""Every operator and report over match-shaped data, with SQL to compare with."""
