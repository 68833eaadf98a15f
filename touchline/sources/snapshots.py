"""Dated snapshots per league, and the merge of the latest ones.

Layout: ``<base>/<table>/league=<code>/snapshot_date=<day>/batch=<run>``. A run that
is not scoped to one league is filed under ``all``. A run repeated on the same day
adds a batch, and files are never overwritten: the latest snapshot of a league is
the last batch of its last day whose competitions, written last, are there.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.load import new_matches, require_keys
from touchline.operators.merge import merge_wide, rank_leagues
from touchline.operators.transform import extract_competitions, extract_teams
from touchline.schema import COMPETITIONS, LEAGUE_ORDER, MATCH_FACTS, TEAMS
from touchline.sources.paths import exists
from touchline.sources.scratch import Scratch, scratch_path, write_and_read
from touchline.tables import MatchTables

_SCHEMAS = {"competitions": COMPETITIONS, "teams": TEAMS, "matches": MATCH_FACTS}
_PLACE = T.StructType(
    [T.StructField("league", T.StringType()), T.StructField("snapshot_date", T.DateType()),
     T.StructField("batch", T.StringType())]
)


def write_league_snapshot(base: str, matches: DataFrame, day: date,
                          league: str | None = None) -> int:
    """File one run's transformed matches as the league's snapshot of the day.

    A snapshot starts from nothing, so its competition ids count from 1.
    Competitions are written last: a league counts as present once they are.
    Without matches nothing is written. Returns the number of matches.
    """
    with Scratch(matches.sparkSession, "snapshot") as scratch:
        return _write_snapshot(base, scratch.materialize(matches, "batch"), day, league)


def _write_snapshot(base: str, batch: DataFrame, day: date, league: str | None) -> int:
    count = batch.count()
    if count == 0:
        return 0
    require_keys(batch)
    batch_id = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    place = f"league={league or 'all'}/snapshot_date={day.isoformat()}/batch={batch_id}"
    competitions = extract_competitions(batch)
    none = batch.sparkSession.createDataFrame([], MATCH_FACTS)
    parts = {
        "matches": new_matches(none, competitions, batch).select(*MATCH_FACTS.names),
        "teams": extract_teams(batch).toDF(*TEAMS.names),
        "competitions": competitions,
    }
    for name, rows in parts.items():
        rows.hint("rebalance").write.parquet(f"{base}/{name}/{place}")
    return count


def _read(spark: SparkSession, base: str, name: str) -> DataFrame:
    schema = _SCHEMAS[name]
    dated = T.StructType([*schema.fields, *_PLACE.fields])
    return spark.read.schema(dated).parquet(f"{base}/{name}")


def latest_snapshots(spark: SparkSession, base: str,
                     leagues: Iterable[str] | None = None) -> DataFrame:
    """The last day and its last batch per league, from the small competitions table."""
    rows = _read(spark, base, "competitions")
    if leagues is not None:
        rows = rows.filter(F.col("league").isin(list(leagues)))
    last = rows.groupBy("league").agg(F.max(F.struct("snapshot_date", "batch")).alias("last"))
    return last.select("league", "last.snapshot_date", "last.batch")


def read_snapshots(spark: SparkSession, base: str, name: str, chosen: DataFrame) -> DataFrame:
    """A table's rows in the chosen snapshots (league, snapshot_date, batch), with ``league``."""
    # One row per league. Spark does not know that it is so small, and a shuffle by snapshot
    # would leave all rows of a league to one task.
    rows = _read(spark, base, name).join(
        F.broadcast(chosen), ["league", "snapshot_date", "batch"], "left_semi")
    return rows.drop("snapshot_date", "batch")


def read_league_snapshots(spark: SparkSession, base: str, leagues: Iterable[str] = LEAGUE_ORDER,
                          order: Iterable[str] = LEAGUE_ORDER) -> dict[str, DataFrame]:
    """Latest competitions, teams and wide matches of each league that has any.

    Raises when no league has a snapshot.
    """
    if not exists(spark, f"{base}/competitions"):
        raise FileNotFoundError(f"No league snapshots under {base}")
    latest = latest_snapshots(spark, base, leagues)
    if latest.isEmpty():
        raise FileNotFoundError(f"No league snapshots under {base} for {list(leagues)}")

    return {name: rank_leagues(read_snapshots(spark, base, name, latest), tuple(order))
            for name in _SCHEMAS}


def read_merged(spark: SparkSession, base: str, leagues: Iterable[str] = LEAGUE_ORDER,
                order: Iterable[str] = LEAGUE_ORDER, target: str | None = None) -> MatchTables:
    """The latest snapshots of all leagues as one set of tables.

    They are merged once and written to ``target``, a new folder in the scratch
    folder by default; reports read the written tables.
    """
    parts = read_league_snapshots(spark, base, leagues, order)
    merged = merge_wide(parts["competitions"], parts["teams"], parts["matches"])
    target = target or scratch_path(spark, "merged")
    names = ("competitions", "teams", "matches")
    return MatchTables.from_wide(
        *[write_and_read(rows, f"{target}/{name}") for name, rows in zip(names, merged)])
