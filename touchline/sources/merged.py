"""Merged snapshots that are kept and brought up to date.

``refresh_merged`` keeps, per league, the rows of its latest snapshot that win the merge::

    matches/part=…/league=…   teams/part=…/league=…   commits/<number>.json

A commit names each league's snapshot and the part its rows lie in. When a league has a newer
snapshot, that league is merged again, and with it only those leagues that share an id with
its old or its new snapshot; the parts of all others are named again as they are. Matches
carry the code of their competition, so that the numbering, which all snapshots decide
together, is joined when they are read. The result is that of a full merge.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.merge import keep_last, merge_competitions, rank_leagues
from touchline.schema import LEAGUE_ORDER, MATCH_FACTS, MATCHES, METRICS, TEAMS
from touchline.sources.paths import create_new, exists
from touchline.sources.snapshots import latest_snapshots, read_snapshots
from touchline.tables import MatchTables

KINDS = ("teams", "matches")
_PART = T.StructType([
    T.StructField("league", T.StringType()), T.StructField("snapshot_date", T.StringType()),
    T.StructField("batch", T.StringType()),
    *[T.StructField(kind, T.StringType()) for kind in KINDS]])
_COMMIT = T.StructType([T.StructField("number", T.LongType()), T.StructField("leagues", T.ArrayType(_PART))])
_CODED = T.StructType([
    *[field for field in MATCH_FACTS.fields if field.name != "competition_id"],
    T.StructField("code", T.StringType())])
_STORED = {"teams": TEAMS, "matches": _CODED}


def merged_parts(spark: SparkSession, target: str) -> tuple[int, dict[str, dict]]:
    """The last commit's number, and its snapshot and parts per league."""
    if not exists(spark, f"{target}/commits"):
        return 0, {}
    rows = spark.read.schema(_COMMIT).json(f"{target}/commits")
    last = rows.orderBy(F.desc("number")).first()
    return last["number"], {row["league"]: row.asDict() for row in last["leagues"]}


def _coded(matches: DataFrame, competitions: DataFrame) -> DataFrame:
    """Matches with the code of their competition for the snapshot's own number of it."""
    codes = competitions.select("league", F.col("id").alias("competition_id"), "code")
    return matches.join(codes, ["league", "competition_id"], "left").drop("competition_id")


def _chosen(spark: SparkSession, places: Iterable[dict]) -> DataFrame:
    """Snapshots as rows: league, snapshot_date, batch."""
    rows = [(p["league"], p["snapshot_date"], p["batch"]) for p in places]
    return spark.createDataFrame(rows, "league string, snapshot_date string, batch string").withColumn(
        "snapshot_date", F.to_date("snapshot_date"))


def refresh_merged(spark: SparkSession, base: str, target: str, leagues: Iterable[str] = LEAGUE_ORDER,
                   order: Iterable[str] = LEAGUE_ORDER) -> MatchTables:
    """Bring the merged tables up to the latest snapshots, and read them."""
    order, number, before = tuple(order), *merged_parts(spark, target)
    # One row per league.
    latest = {row["league"]: {**row.asDict(), "snapshot_date": row["snapshot_date"].isoformat()}
              for row in latest_snapshots(spark, base, list(leagues)).collect()}
    if not latest:
        raise FileNotFoundError(f"No league snapshots under {base} for {list(leagues)}")
    same = {name for name, place in latest.items()
            if name in before and before[name]["batch"] == place["batch"]}
    gone = [before[name] for name in before if name not in latest]
    changed = [name for name in latest if name not in same]
    if changed or gone:
        # Snapshots whose ids may have other winners now, as they were and as they are.
        moved = [before[name] for name in changed if name in before] + gone + [latest[name] for name in changed]
        part, parts = uuid.uuid4().hex, {name: dict(before.get(name, {}), **latest[name]) for name in latest}
        for kind in KINDS:
            again = set(changed) | _sharing(spark, base, kind, moved, [latest[name] for name in same])
            _write_part(spark, base, target, kind, part, latest, sorted(again), order)
            for name in again:
                parts[name][kind] = part
        line = {"number": number + 1, "leagues": list(parts.values())}
        if not create_new(spark, f"{target}/commits/{number + 1:012d}.json", json.dumps(line) + "\n"):
            return refresh_merged(spark, base, target, leagues, order)  # another writer was first
    return read_refreshed(spark, base, target, order)


def _sharing(spark: SparkSession, base: str, kind: str, moved: list[dict], others: list[dict]) -> set[str]:
    """Leagues among the unchanged ones that share an id with the moved snapshots."""
    if not others:
        return set()
    ids = read_snapshots(spark, base, kind, _chosen(spark, moved)).select("id").distinct()
    rows = read_snapshots(spark, base, kind, _chosen(spark, others)).select("league", "id")
    return {row["league"] for row in rows.join(ids, "id", "left_semi").select("league").distinct().collect()}


def _write_part(spark: SparkSession, base: str, target: str, kind: str, part: str,
                latest: dict[str, dict], leagues: list[str], order: tuple[str, ...]) -> None:
    """The winning rows of the given leagues, against all leagues that have their ids."""
    every = read_snapshots(spark, base, kind, _chosen(spark, latest.values()))
    own = F.col("league").isin(leagues)
    ids = every.filter(own).select("id").distinct()
    # Of leagues that are not written, only rows with these ids can win over theirs.
    rivals = every.filter(~own).join(ids, "id", "left_semi")
    won = keep_last(rank_leagues(every.filter(own).unionByName(rivals), order), "id").filter(own)
    if kind == "matches":
        won = _coded(won, read_snapshots(spark, base, "competitions", _chosen(spark, latest.values())))
    rows = won.select(*_STORED[kind].names, "league")
    rows.hint("rebalance", "league").write.partitionBy("league").parquet(f"{target}/{kind}/part={part}")


def read_refreshed(spark: SparkSession, base: str, target: str,
                   order: Iterable[str] = LEAGUE_ORDER) -> MatchTables:
    """The merged tables of the last commit; an error when there are no matches."""
    _, parts = merged_parts(spark, target)
    def stored(kind: str) -> DataFrame:
        schema = T.StructType([*_STORED[kind].fields, T.StructField("part", T.StringType()),
                               T.StructField("league", T.StringType())])
        rows = spark.read.schema(schema).parquet(f"{target}/{kind}")
        # A part holds one league or more. Other parts are pruned from the scan, and nothing is
        # shuffled: by league, a task would get all rows of one.
        leagues = {}
        for place in parts.values():
            leagues.setdefault(place[kind], []).append(place["league"])
        return rows.where(reduce(or_, [
            (F.col("part") == part) & F.col("league").isin(names) for part, names in leagues.items()]))

    chosen = _chosen(spark, parts.values())
    competitions = merge_competitions(rank_leagues(
        read_snapshots(spark, base, "competitions", chosen), tuple(order)))
    matches = stored("matches")
    if matches.isEmpty():
        raise ValueError("No match data found in any snapshot.")
    numbered = competitions.select(F.col("id").alias("competition_id"), "code")
    wide = matches.join(numbered, "code", "left").select(*MATCHES.names, *METRICS)
    return MatchTables.from_wide(competitions, stored("teams").select(*TEAMS.names), wide)
