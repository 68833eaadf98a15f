"""Set-based, insert-if-absent loading of the normalized tables.

Each function returns the rows to append. Rows that are already stored are
never changed: a corrected score or a new team name does not land.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.schema import MATCHES, METRICS


def absent(incoming: DataFrame, existing: DataFrame, key: str, existing_key: str) -> DataFrame:
    """Incoming rows whose key is not stored yet.

    The stored keys are first cut down to those the batch mentions. A batch is
    small next to the table, so that step broadcasts the batch (if its size
    allows) instead of shuffling every stored key.
    """
    batch_keys = incoming.select(F.col(key).alias("batch_key"))
    known = existing.select(F.col(existing_key).alias("known_key")).join(
        batch_keys, F.col("known_key") == F.col("batch_key"), "left_semi"
    )
    return incoming.join(known, F.col(key) == F.col("known_key"), "left_anti")


def new_competitions(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Competitions with unseen codes, numbered after the highest stored id."""
    fresh = absent(found.select("code", "name"), existing, "code", "code")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    # One row per new league reaches this window.
    number = F.row_number().over(Window.orderBy("code"))
    return fresh.select((top + number).cast("bigint").alias("id"), "code", "name")


def new_teams(existing: DataFrame, found: DataFrame) -> DataFrame:
    rows = found.select(F.col("team_id").alias("id"), F.col("team_name").alias("name"))
    return absent(rows, existing, "id", "id")


def new_matches(existing: DataFrame, competitions: DataFrame, matches: DataFrame) -> DataFrame:
    """Unseen matches with the id of their competition."""
    ids = competitions.select(F.col("id").alias("competition_id"), "code")
    fresh = absent(matches, existing, "match_id", "id").withColumnRenamed("match_id", "id")
    linked = fresh.join(ids, F.col("competition_code") == F.col("code"), "left")
    extra = [name for name in METRICS if name in matches.columns]
    return linked.select(*MATCHES.names, *extra)


def new_metrics(existing: DataFrame, stored_matches: DataFrame, matches: DataFrame) -> DataFrame:
    """Metrics not stored yet, of matches that are stored."""
    fresh = absent(matches.select("match_id", *METRICS), existing, "match_id", "match_id")
    parents = stored_matches.select(F.col("id").alias("match_id"))
    return fresh.join(parents, "match_id", "left_semi")


REQUIRED = {
    "match_id": "match id",
    "competition_code": "competition code",
    "competition_name": "competition name",
    "home_team_id": "home team id",
    "away_team_id": "away team id",
    "home_team_name": "home team name",
    "away_team_name": "away team name",
}


def missing_values() -> dict[str, Column]:
    """Aggregates: how many matches lack each required value."""
    return {name: F.count_if(F.col(name).isNull()) for name in REQUIRED}


def key_checks(matches: DataFrame) -> DataFrame:
    """One row: how many matches lack each required value."""
    return matches.agg(*[value.alias(name) for name, value in missing_values().items()])


def orphan_checks(tables) -> DataFrame:
    """One row: matches without their competition, home team or away team, and
    metrics without their match."""
    checks = ("no_match", "no_competition", "no_home_team", "no_away_team")

    def names(kind: str, key: str, check: str | None = None) -> Column:
        """A row that names a parent, or (without ``check``) one that is the parent."""
        return F.struct(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("key"),
                        F.lit(check).cast("string").alias("check"))

    # Each match is a parent and names three at once: one pass over each table, counted
    # per key before the shuffle, so that a key with very many rows stays cheap.
    parts = [
        tables.matches.select(F.inline(F.array(
            names("match", "id"), names("competition", "competition_id", "no_competition"),
            names("team", "home_team_id", "no_home_team"), names("team", "away_team_id", "no_away_team")))),
        tables.match_metrics.select(F.inline(F.array(names("match", "match_id", "no_match")))),
        tables.competitions.select(F.inline(F.array(names("competition", "id")))),
        tables.teams.select(F.inline(F.array(names("team", "id")))),
    ]
    named = parts[0]
    for part in parts[1:]:
        named = named.unionByName(part)
    by_key = named.groupBy("kind", "key").agg(
        F.count_if(F.col("check").isNull() & F.col("key").isNotNull()).alias("parents"),
        *[F.count_if(F.col("check") == check).alias(check) for check in checks])
    lost = by_key.filter(F.col("parents") == 0)
    return lost.agg(*[F.coalesce(F.sum(check), F.lit(0)).alias(check) for check in checks])


def require_keys(matches: DataFrame) -> None:
    """Fail before anything is written when a required value is missing."""
    require_values(key_checks(matches).first().asDict())


def require_values(counts: dict) -> None:
    """The same for counts that are known already."""
    broken = {label: counts[name] for name, label in REQUIRED.items() if counts[name]}
    if broken:
        raise ValueError(f"Matches with missing values: {broken}")

