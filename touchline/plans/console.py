"""The five-section text report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from touchline.plans import goals, outcomes, shape
from touchline.tables import MatchTables

RULE = "-" * 64
NO_DATA = "No data in the tables yet: load matches first."


def sections(tables: MatchTables, top_n: int = 10, window: int = 5) -> dict[str, DataFrame]:
    """Title → rows, in print order."""
    # The sections' titles.
    columns = ["competition", *shape.STANDINGS_LABELS]
    return {
        "LEAGUE STANDINGS": shape.standings_top_n(outcomes.standings(tables), top_n).select(
            *columns
        ),
        f"RECENT FORM (last {window})": shape.form_top(outcomes.team_form(tables, window=window)),
        "HOME vs AWAY SPLITS": outcomes.home_away_splits(tables),
        "TOP SCORING TEAMS (avg goals / match)": goals.top_scoring_teams(tables),
        "SCORING BY MONTH": goals.goals_by_month(tables).drop("month"),
    }


def console_report(tables: MatchTables, out: Callable[[str], None] = print) -> None:
    """Write the report line by line; empty sections are left out."""
    if outcomes.summary(tables).isEmpty():
        out(NO_DATA)
        return
    for title, rows in sections(tables).items():
        names = rows.columns
        for number, row in enumerate(rows.toLocalIterator()):
            if number == 0:
                out(f"\n{RULE}\n  {title}\n{RULE}")
                out("  ".join(name.rjust(12) for name in names))
            out("  ".join(("" if row[name] is None else str(row[name])).rjust(12)
                          for name in names))
