"""The core primitive: one match seen from both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.tables import MatchTables


def _sides(matches: DataFrame) -> tuple[DataFrame, Callable[[str, str], Column]]:
    """Each match twice, with a picker of the home or the away expression.

    Exploding a two-value literal reads the matches once, and the columns a
    report does not use are still pruned from the scan.
    """
    rows = matches.withColumn("venue", F.explode(F.array(F.lit("home"), F.lit("away"))))
    at_home = F.col("venue") == "home"

    def pick(home: str, away: str) -> Column:
        return F.when(at_home, F.col(home)).otherwise(F.col(away))

    return rows, pick


_LEAGUE = ("competition_id", "competition", "competition_code")


def goal_lines(tables: MatchTables, code: str | None = None, league: bool = True) -> DataFrame:
    """Both sides of every match, metrics or not: opponent, goals for and against.

    Without ``league`` the matches are taken whether their competition is known
    or not, and carry no league columns.
    """
    matches = tables.in_league(tables.results, code) if league else tables.results
    rows, pick = _sides(matches)
    return rows.select(
        *(_LEAGUE if league else ()),
        "match_id", "match_date", "matchday", "venue",
        pick("home_team_id", "away_team_id").alias("team_id"),
        pick("away_team_id", "home_team_id").alias("opponent_id"),
        pick("home_score_ft", "away_score_ft").alias("gf"),
        pick("away_score_ft", "home_score_ft").alias("ga"),
    )


def appearances(tables: MatchTables, code: str | None = None, league: bool = True) -> DataFrame:
    """Both sides of every measured match, with outcome and points."""
    facts = tables.in_league(tables.facts, code) if league else tables.facts
    rows, pick = _sides(facts)
    w, d = pick("home_win", "away_win"), F.col("is_draw")
    return rows.select(
        *(_LEAGUE if league else ()),
        "match_id", "match_date", "matchday", "venue",
        pick("home_team_id", "away_team_id").alias("team_id"),
        pick("away_team_id", "home_team_id").alias("opponent_id"),
        pick("home_score_ft", "away_score_ft").alias("gf"),
        pick("away_score_ft", "home_score_ft").alias("ga"),
        w.alias("w"),
        d.alias("d"),
        pick("away_win", "home_win").alias("l"),
        F.when(w == 1, 3).when(d == 1, 1).otherwise(0).cast("bigint").alias("points"),
        pick("clean_sheet_home", "clean_sheet_away").alias("clean_sheet"),
        F.col("both_teams_scored").alias("btts"),
        "high_scoring",
    )
