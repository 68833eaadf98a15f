"""Reports by name, and a short-lived cache of their results."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.plans import outcomes, sequences
from touchline.plans.goals import efficiency_matrix
from touchline.sources.paths import create_new, exists, remove
from touchline.sources.store import MatchStore
from touchline.tables import MatchTables

_LINE, _RESULT = "_line", "version long, result string"

# Seconds a report and the source stay cached.
REPORT_TTL, SOURCE_TTL = 300, 1800


def report(tables: MatchTables, name: str, code: str | None = None, window: int = 5,
           through_matchday: int | None = None) -> DataFrame:
    """One of the nine named reports."""
    builders: dict[str, Callable[[], DataFrame]] = {
        "summary": lambda: outcomes.summary(tables, code),
        "standings": lambda: outcomes.standings(tables, code, through_matchday),
        "efficiency": lambda: efficiency_matrix(tables, code),
        "form": lambda: outcomes.team_form(tables, code, window),
        "splits": lambda: outcomes.home_away_splits(tables, code),
        "fatigue": lambda: sequences.schedule_density(tables, code),
        "resilience": lambda: sequences.bounce_back(tables, code),
        "parity": lambda: sequences.competitive_balance(tables, code),
        "defense": lambda: sequences.defensive_solidity(tables, code),
    }
    if name not in builders:
        raise ValueError(f"Unknown report: {name}")
    return builders[name]()


class StoredReports:
    """Results of reports as tables that any session can read, each for one commit.

    A request first looks at the store's last commit. A result that was worked out for it
    is read; else the report runs on the tables as of that commit, and its result is
    written and takes the place of the older ones. So a load changes the next answer, and
    without one no report runs twice, whichever session asks.
    """

    def __init__(self, store: MatchStore, path: str):
        self._store = store
        self._path = path.rstrip("/")

    def report(self, name: str, code: str | None = None, window: int = 5,
               through_matchday: int | None = None) -> DataFrame:
        spark, version = self._store.spark, self._store.version()
        wanted = json.dumps([name, code, window, through_matchday])
        folder = f"{self._path}/{name}-{hashlib.sha256(wanted.encode()).hexdigest()[:16]}"
        mark = f"{folder}/{version:012d}.json"
        if not exists(spark, mark):
            rows = report(self._store.tables(version), name, code, window, through_matchday)
            # The order of the rows is part of a report.
            result = f"{folder}/result-{uuid.uuid4().hex}"
            rows.withColumn(_LINE, F.monotonically_increasing_id()).write.parquet(result)
            if create_new(spark, mark, json.dumps({"version": version, "result": result}) + "\n"):
                self._drop_before(folder, version)
        result = spark.read.schema(_RESULT).json(mark).first()["result"]
        return spark.read.parquet(result).orderBy(_LINE).drop(_LINE)

    def _drop_before(self, folder: str, version: int) -> None:
        """Remove older results but the last, which may still be read. Its mark goes first."""
        spark = self._store.spark
        marks = spark.read.schema(_RESULT).json(f"{folder}/*.json").filter(F.col("version") < version)
        for row in marks.orderBy(F.desc("version")).collect()[1:]:  # one row per kept result
            remove(spark, f"{folder}/{row['version']:012d}.json")
            remove(spark, row["result"])


class CachedReports:
    """Persisted reports per filter combination, dropped after their time.

    Only results are kept: the tables stay where they are, and a lost executor
    costs a recomputation of its share. ``source`` is called again, and
    everything released, once the source's own time is over.
    """

    def __init__(self, source: Callable[[], MatchTables], report_ttl: float = REPORT_TTL,
                 source_ttl: float = SOURCE_TTL, clock: Callable[[], float] = time.monotonic):
        self._source = source
        self._report_ttl = report_ttl
        self._source_ttl = source_ttl
        self._clock = clock
        self._tables: MatchTables | None = None
        self._loaded_at = 0.0
        self._kept: dict[tuple, tuple[float, DataFrame]] = {}

    def tables(self) -> MatchTables:
        now = self._clock()
        if self._tables is None or now - self._loaded_at >= self._source_ttl:
            self.release()
            self._tables, self._loaded_at = self._source(), now
        return self._tables

    def report(self, name: str, code: str | None = None, window: int = 5,
               through_matchday: int | None = None) -> DataFrame:
        tables = self.tables()
        key = (name, code, window, through_matchday)
        now = self._clock()
        if key in self._kept:
            kept_at, rows = self._kept[key]
            if now - kept_at < self._report_ttl:
                return rows
            rows.unpersist()
        rows = report(tables, name, code, window, through_matchday)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        self._kept[key] = (now, rows)
        return rows

    def release(self) -> None:
        for _, rows in self._kept.values():
            rows.unpersist()
        self._kept.clear()
        self._tables = None
