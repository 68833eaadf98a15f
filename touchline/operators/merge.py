"""Merging league snapshots into one set of tables.

Inputs are tables with two more columns: ``league``, the snapshot a row came
from, and ``league_rank``, its place in the merge order. The last version of a
row wins, unlike in the transform and the load, where the first one does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.schema import LEAGUE_ORDER, MATCHES, METRICS
from touchline.tables import MatchTables


def rank_leagues(rows: DataFrame, order=LEAGUE_ORDER) -> DataFrame:
    """Add ``league_rank`` from the merge order; other leagues come last."""
    place = F.array_position(F.array(*[F.lit(code) for code in order]), F.col("league"))
    rank = F.when(place > 0, place).otherwise(F.lit(len(order) + 1))
    return rows.withColumn("league_rank", rank.cast("bigint"))


def keep_last(rows: DataFrame, key: str) -> DataFrame:
    """The row of the last snapshot per key; a group limit bounds the shuffle."""
    last = Window.partitionBy(key).orderBy(F.desc("league_rank"), F.desc("league"))
    return (
        rows.withColumn("version", F.row_number().over(last))
        .filter(F.col("version") == 1)
        .drop("version")
    )


def merge_competitions(competitions: DataFrame) -> DataFrame:
    """Last version per code, with fresh ids 1..n in merge order."""
    kept = keep_last(competitions, "code")
    # One row per league reaches this window.
    order = Window.orderBy("league_rank", "league", "id")
    number = F.row_number().over(order).cast("bigint")
    return kept.select(number.alias("new_id"), "code", "name").withColumnRenamed("new_id", "id")


def merge_teams(teams: DataFrame) -> DataFrame:
    return keep_last(teams, "id").select("id", "name")


def merge_matches(matches: DataFrame, competitions: DataFrame) -> DataFrame:
    """Last version per match; competition ids go from the snapshot's own
    numbering to the merged one. An unknown competition gives a null id."""
    merged = merge_competitions(competitions)
    renumbered = (
        competitions.select("league", F.col("id").alias("competition_id"), "code")
        .join(merged.select(F.col("id").alias("merged_id"), "code"), "code")
        .select("league", "competition_id", "merged_id")
    )
    extra = [name for name in METRICS if name in matches.columns]
    return (
        keep_last(matches, "id")
        .join(renumbered, ["league", "competition_id"], "left")
        .drop("competition_id")
        .withColumnRenamed("merged_id", "competition_id")
        .select(*MATCHES.names, *extra)
    )


def merge_metrics(metrics: DataFrame) -> DataFrame:
    return keep_last(metrics, "match_id").select("match_id", *METRICS)


def merge_wide(competitions: DataFrame, teams: DataFrame,
               matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Competitions, teams and matches merged; it is an error when no matches are left."""
    sources = competitions.select("league").distinct()
    known_matches = matches.join(sources, "league", "left_semi")
    if known_matches.isEmpty():
        raise ValueError("No match data found in any snapshot.")
    known_teams = teams.join(sources, "league", "left_semi")
    return (merge_competitions(competitions), merge_teams(known_teams),
            merge_matches(known_matches, competitions))


def merge_league_snapshots(competitions: DataFrame, teams: DataFrame, matches: DataFrame,
                           metrics: DataFrame | None = None) -> MatchTables:
    """All four tables merged. Snapshots without competitions are left out.

    ``metrics`` may be missing altogether: with wide matches they come along,
    otherwise the merged table is empty.
    """
    merged, kept_teams, kept_matches = merge_wide(competitions, teams, matches)
    if metrics is None and "total_goals" in matches.columns:
        return MatchTables.from_wide(merged, kept_teams, kept_matches)
    if metrics is None:
        none = F.lit(None).cast("bigint")
        empty = kept_matches.filter(F.lit(False)).select(
            F.col("id").alias("match_id"), *[none.alias(name) for name in METRICS]
        )
        return MatchTables(merged, kept_teams, kept_matches, empty)
    known = metrics.join(competitions.select("league").distinct(), "league", "left_semi")
    return MatchTables(merged, kept_teams, kept_matches, merge_metrics(known))
