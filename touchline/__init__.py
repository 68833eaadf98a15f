"""Touchline: two-sided sports results as Spark DataFrames.

Feeds of nested match JSON go in, four normalized tables come out, and every
report over them is a lazy ``DataFrame``.
"""

from touchline.plans.dispatch import report
from touchline.tables import MatchTables

__all__ = ["MatchTables", "report"]
