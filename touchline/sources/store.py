"""The stored tables: append-only loads that appear all at once.

Layout under one base path::

    competitions/batch=…   teams/batch=…   matches/batch=…/competition_id=…
    ids/batch=…            commits/<number>.json

``matches`` keeps a match and its metrics on one row, and ``ids`` says which match ids a
batch holds: a bitmap for each block of 2**15 ids. A load writes its tables under a new
batch and then a commit that names the batch. Readers see only committed batches, so a
load that fails half-way leaves nothing visible and can be repeated. Stored files are
never rewritten: ``compact`` writes one batch that takes the place of the ones before it.

Which ids are new is read off the bitmaps alone, exactly; no file of matches is opened.
A commit names the lowest and highest id of its batch, so batches out of range are not
looked at, and one that shares the range (leagues count in one space of ids) costs its
bitmaps of the blocks the load touches.

Commits are numbered, and a number is given once (``create_new``). Writers may overlap:
the one that finds its number taken looks at what was committed meanwhile. If that added
none of its matches or teams, and no competitions beside its own, it takes the next number;
else it works out again what is new. So no match, team or competition number comes twice.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.bitmaps import bitmaps, has_bit
from touchline.operators.load import (
    missing_values, new_competitions, new_matches, new_teams, require_values)
from touchline.operators.transform import extract_competitions, extract_teams
from touchline.schema import COMPETITIONS, MATCH_FACTS, TEAMS
from touchline.sources.paths import create_new, exists
from touchline.sources.scratch import Scratch, observed_write
from touchline.tables import MatchTables

_IDS = T.StructType([T.StructField("block", T.LongType()), T.StructField("bitmap", T.BinaryType())])
_SCHEMAS = {"competitions": COMPETITIONS, "teams": TEAMS, "matches": MATCH_FACTS, "ids": _IDS}
_BATCH = T.StructField("batch", T.StringType())
_COMMIT = T.StructType([
    T.StructField("number", T.LongType()),
    _BATCH,
    T.StructField("load_id", T.StringType()),
    T.StructField("low_id", T.LongType()),
    T.StructField("high_id", T.LongType()),
    # How many rows of each kind the batch adds; a compacted batch adds none.
    T.StructField("competitions", T.LongType()),
    T.StructField("teams", T.LongType()),
    T.StructField("matches", T.LongType()),
    T.StructField("replaces", T.ArrayType(T.StringType())),
])


def load_facts() -> dict[str, Column]:
    """Aggregates over transformed matches that a load needs, from one pass."""
    return {
        "rows": F.count("*"),
        "low_id": F.min("match_id"),
        "high_id": F.max("match_id"),
        **{f"no_{name}": value for name, value in missing_values().items()},
    }


@dataclass(frozen=True)
class _Batch:
    """A written batch, and the last commit it was worked out against."""

    name: str
    after: int
    low_id: int | None
    high_id: int | None
    competitions: int
    teams: int
    matches: int


class MatchStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    # Commits

    def _commits(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/commits"):
            return self.spark.createDataFrame([], _COMMIT)
        return self.spark.read.schema(_COMMIT).json(f"{self.path}/commits")

    def is_committed(self, load_id: str) -> bool:
        return not self._commits().filter(F.col("load_id") == load_id).isEmpty()

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return self._commits().agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]

    def _live(self, after: int | None = None) -> DataFrame:
        """Commits whose batch none has replaced, up to the one numbered ``after``."""
        commits = self._commits()
        if after is not None:
            commits = commits.filter(F.col("number") <= after)
        gone = commits.select(F.explode("replaces").alias("batch"))
        return commits.join(gone, "batch", "left_anti")

    def _commit(self, load_id: str, batch: _Batch, number: int, replaces: list[str] = ()) -> bool:
        """Make the batch visible under a number; False when the number is taken."""
        added = {"competitions": batch.competitions, "teams": batch.teams, "matches": batch.matches}
        line = {"number": number, "batch": batch.name, "load_id": load_id, "low_id": batch.low_id,
                "high_id": batch.high_id, **added, "replaces": list(replaces)}
        return create_new(self.spark, f"{self.path}/commits/{number:012d}.json", json.dumps(line) + "\n")

    # Reading

    def _all_batches(self, name: str) -> DataFrame:
        schema = T.StructType([*_SCHEMAS[name].fields, _BATCH])
        base = f"{self.path}/{name}"
        if not exists(self.spark, base):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(base)

    def _read(self, name: str, after: int | None = None) -> DataFrame:
        # One row per load: while that is small, Spark broadcasts it and prunes
        # all other batches from the scan.
        return self._all_batches(name).join(self._live(after), "batch", "left_semi").drop("batch")

    def tables(self, after: int | None = None) -> MatchTables:
        """The stored tables, as of now or of an earlier commit."""
        return MatchTables.from_wide(*[
            self._read(name, after) for name in ("competitions", "teams", "matches")])

    def known_ids(self, ids: DataFrame, low: int, high: int, commits: DataFrame) -> DataFrame:
        """Which of the ids (a column ``id``, between low and high) the commits' batches hold."""
        near = commits.filter((F.col("low_id") <= high) & (F.col("high_id") >= low))
        number = lambda value: F.bitmap_bucket_number(F.lit(value).cast("bigint"))
        index = (
            self._all_batches("ids")
            .filter(F.col("block").between(number(low), number(high)))
            .join(near, "batch", "left_semi")
        )
        placed = ids.withColumn("block", F.bitmap_bucket_number("id"))
        return placed.join(index, "block").filter(has_bit(F.col("bitmap"), F.col("id"))).select("id")

    # Writing

    def load(self, matches: DataFrame, teams: DataFrame | None = None,
             load_id: str | None = None) -> int:
        """Add transformed matches and their teams; returns how many matches were new.

        Loading the same matches again adds nothing, and so does repeating a
        load under the same ``load_id``. Teams default to those in the matches.
        """
        with Scratch(self.spark, "load") as scratch:
            written, facts = scratch.materialize_observed(matches, "batch", load_facts())
            return self.load_written(written, teams, load_id, facts)

    def load_written(self, matches: DataFrame, teams: DataFrame | None = None,
                     load_id: str | None = None, facts: dict | None = None) -> int:
        """``load`` for matches that are already read from a written table; ``facts`` are
        the values of ``load_facts`` when the pass that wrote it has them."""
        load_id = load_id or uuid.uuid4().hex
        if self.is_committed(load_id):
            return 0
        if facts is None:
            facts = matches.agg(*[value.alias(name) for name, value in load_facts().items()]).first().asDict()
        if not facts["rows"]:
            return 0
        require_values({name.removeprefix("no_"): n for name, n in facts.items()})
        while True:
            batch = self._stage(matches, extract_teams(matches) if teams is None else teams, facts)
            added = self._publish(load_id, batch)
            if added is not None:
                return added

    def _stage(self, matches: DataFrame, teams: DataFrame, facts: dict) -> _Batch:
        """Write what is new against the last commit under a new batch."""
        after, name = self.version(), uuid.uuid4().hex
        stored = self.tables(after)
        leagues = self._write("competitions", name, new_competitions(
            stored.competitions, extract_competitions(matches)))
        # Read the new ids back: the numbering is then fixed for the matches.
        competitions = stored.competitions.unionByName(self._written("competitions", name))
        clubs = self._write("teams", name, new_teams(stored.teams, teams))
        ids = matches.select(F.col("match_id").alias("id"))
        known = self.known_ids(ids, facts["low_id"], facts["high_id"], self._live(after))
        fresh = new_matches(known, competitions, matches).select(*MATCH_FACTS.names)
        games = self._write("matches", name, fresh, by="competition_id")
        self._write("ids", name, bitmaps(self._written("matches", name), "id"))
        return _Batch(name, after, games["low"], games["high"], leagues["rows"], clubs["rows"], games["rows"])

    def _publish(self, load_id: str, batch: _Batch) -> int | None:
        """Commit the batch; None when other commits have added some of it meanwhile."""
        after = batch.after
        while not self._commit(load_id, batch, after + 1):
            others = self._commits().filter((F.col("number") > after) & (F.size("replaces") == 0))
            if self.is_committed(load_id):
                return 0
            if self._clash(batch, others):
                return None
            after = self.version()
        return batch.matches

    def _clash(self, batch: _Batch, others: DataFrame) -> bool:
        added = others.agg(F.sum("competitions"), F.sum("teams")).first()
        if batch.competitions and added[0]:
            return True
        if batch.teams and added[1]:
            theirs = self._all_batches("teams").join(others, "batch", "left_semi")
            if not theirs.join(self._written("teams", batch.name), "id", "left_semi").isEmpty():
                return True
        if not batch.matches:
            return False
        mine = self._written("matches", batch.name).select("id")
        return not self.known_ids(mine, batch.low_id, batch.high_id, others).isEmpty()

    def compact(self) -> None:
        """Put all batches into one, whose commit takes the place of theirs.

        The files of the old batches stay until they are removed by hand, so
        readers that are under way are not disturbed. Loads may go on meanwhile; of two
        compactions that overlap, the later one is dropped.
        """
        after = self.version()
        live = self._live(after)
        # The old batches' names: one short text per load since the last compaction.
        old = [row["batch"] for row in live.select("batch").collect()]
        if len(old) < 2:
            return
        name = uuid.uuid4().hex
        for table in ("competitions", "teams"):
            self._write(table, name, self._read(table, after))
        games = self._write("matches", name, self._read("matches", after), by="competition_id")
        together = self._read("ids", after).groupBy("block").agg(F.call_function(
            "bitmap_or_agg", F.col("bitmap")).alias("bitmap"))
        self._write("ids", name, together)
        batch = _Batch(name, after, games["low"], games["high"], 0, 0, 0)
        while not self._commit(f"compact-{name}", batch, after + 1, old):
            newer = self._commits().filter((F.col("number") > after) & (F.size("replaces") > 0))
            if not newer.isEmpty():
                return
            after = self.version()

    def _target(self, name: str, batch: str) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def _write(self, name: str, batch: str, rows: DataFrame, by: str | None = None) -> dict:
        """Write a table of a batch; what was written is counted in the same pass."""
        # Rebalancing sizes the files at run time: it joins small ones, and it
        # splits a league that is much larger than the others.
        sized = rows.hint("rebalance", *([by] if by else []))
        key = "block" if name == "ids" else "id"
        sized = sized.sortWithinPartitions(*([by] if by else []), key)
        counts = {"rows": F.count("*"), "low": F.min(key), "high": F.max(key)}
        return observed_write(sized, counts, lambda frame: (
            frame.write.partitionBy(by) if by else frame.write).parquet(self._target(name, batch)))

    def _written(self, name: str, batch: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(self._target(name, batch))
