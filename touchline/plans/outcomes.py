"""Reports on outcomes: headline figures, league tables, form, home and away."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.rounding import mean, percent
from touchline.operators.appearances import appearances
from touchline.operators.ranking import rank_within
from touchline.tables import MatchTables


def competitions(tables: MatchTables) -> DataFrame:
    """Competitions that have matches, by name."""
    played = tables.matches.select("competition_id").distinct()
    return tables.in_league(played).select(
        F.col("competition_code").alias("code"), F.col("competition").alias("name")
    ).orderBy("name", "code")


def summary(tables: MatchTables, code: str | None = None) -> DataFrame:
    """Headline figures; no row when there are no matches."""
    n = F.count("*")
    facts = tables.in_league(tables.facts, code)
    return facts.agg(
        n.alias("matches"),
        mean("total_goals").alias("avg_goals"),
        percent(F.sum("home_win"), n).alias("home_win_pct"),
        percent(F.sum("away_win"), n).alias("away_win_pct"),
        percent(F.sum("is_draw"), n).alias("draw_pct"),
        percent(F.sum("high_scoring"), n).alias("high_scoring_pct"),
        F.sum("both_teams_scored").alias("btts"),
    ).filter(F.col("matches") > 0)


def matchday_bounds(tables: MatchTables, code: str | None = None) -> DataFrame:
    """First and last matchday; (1, 1) when there is none."""
    bounds = tables.in_league(tables.results, code).agg(
        F.min("matchday").alias("lo"), F.max("matchday").alias("hi")
    )
    return bounds.select(*[F.coalesce(name, F.lit(1)).cast("bigint").alias(name)
                           for name in ("lo", "hi")])


def standings(tables: MatchTables, code: str | None = None,
              through_matchday: int | None = None) -> DataFrame:
    """League tables, optionally as they stood after a matchday.

    Teams are shown by name, so ids that share a name share a row.
    """
    rows = appearances(tables, code)
    if through_matchday is not None:
        rows = rows.filter(F.col("matchday") <= through_matchday)
    counts = ["played", "won", "drawn", "lost", "gf", "ga"]
    # Games are folded per team id first; names join the short result.
    per_id = rows.groupBy("competition_id", "team_id").agg(
        F.count("*").alias("played"),
        F.sum("w").alias("won"),
        F.sum("d").alias("drawn"),
        F.sum("l").alias("lost"),
        F.sum("gf").alias("gf"),
        F.sum("ga").alias("ga"),
    )
    per_name = (
        tables.in_league(tables.named(per_id))
        .groupBy("competition", "competition_code", "team")
        .agg(*[F.sum(name).alias(name) for name in counts])
        # Ranking reads this table twice. Naming every count in both places, in a
        # test that holds for all rows, keeps the two alike, so Spark computes the
        # games' sums only once. Nulls stay.
        .filter(F.hash(*counts) >= F.lit(-(2**31)))
        .withColumn("gd", F.col("gf") - F.col("ga"))
        .withColumn("pts", F.col("won") * 3 + F.col("drawn"))
    )
    return (
        rank_within(per_name, ["competition"], ["pts", "gd", "gf"], "position")
        .select("position", "competition", "competition_code", "team", *counts, "gd", "pts")
        .orderBy("competition", "position", "competition_code", "team")
    )


def recent_matches(tables: MatchTables, code: str | None = None, window: int = 5) -> DataFrame:
    """Each team's latest appearances, newest first.

    The row number plans as a group limit: a task forwards at most ``window``
    rows per team, so the shuffle does not grow with a team's history.
    """
    latest = Window.partitionBy("team_id").orderBy(F.desc("match_date"), F.desc("match_id"))
    return (
        appearances(tables, code)
        .withColumn("recency", F.row_number().over(latest).cast("bigint"))
        .filter(F.col("recency") <= window)
    )


def team_form(tables: MatchTables, code: str | None = None, window: int = 5) -> DataFrame:
    """Results of each team's last ``window`` matches, oldest first.

    Rows are grouped by team name, and only names with exactly ``window`` rows
    count. One row more is enough to tell that a name has too many, so no name
    ever gathers more than ``window + 1`` rows.
    """
    # A missing winner shows as a loss in the form but is not counted as one.
    result = F.when(F.col("w") == 1, "W").when(F.col("d") == 1, "D").otherwise("L")
    latest = tables.named(recent_matches(tables, code, window)).withColumn("result", result)
    oldest = Window.partitionBy("team").orderBy("match_date", "match_id", "team_id")
    capped = latest.withColumn("place", F.row_number().over(oldest)).filter(
        F.col("place") <= window + 1
    )
    games = F.array_sort(F.collect_list(F.struct("place", "result")))
    return (
        capped.groupBy("team")
        .agg(
            F.array_join(F.transform(games, lambda game: game["result"]), "").alias("form"),
            F.sum("w").alias("wins"),
            F.sum("d").alias("draws"),
            F.sum("l").alias("losses"),
            (F.sum("w") * 3 + F.sum("d")).alias("points"),
            F.count("*").alias("games"),
        )
        .filter(F.col("games") == window)
        .drop("games")
        .orderBy(F.desc("points"), F.desc("wins"), "team")
    )


def home_away_splits(tables: MatchTables, code: str | None = None) -> DataFrame:
    """Home, away and draw rates per competition."""
    n = F.count("*")
    return (
        tables.in_league(tables.facts, code)
        .groupBy("competition")
        .agg(
            n.alias("matches"),
            percent(F.sum("home_win"), n).alias("home_win_pct"),
            percent(F.sum("away_win"), n).alias("away_win_pct"),
            percent(F.sum("is_draw"), n).alias("draw_pct"),
            mean("total_goals").alias("avg_goals"),
        )
        .orderBy("competition")
    )
