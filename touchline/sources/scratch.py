"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from touchline.sources.paths import remove


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only on a
    local master that names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors can reach.")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="touchline-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path."""
    return f"{scratch_dir(spark)}/touchline/{label}-{uuid.uuid4().hex}"


class Scratch:
    """Intermediate tables of one job, removed when the job is over."""

    def __init__(self, spark: SparkSession, label: str):
        self._spark = spark
        self.path = scratch_path(spark, label)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self._spark, self.path)

    def materialize(self, rows: DataFrame, name: str) -> DataFrame:
        return write_and_read(rows, f"{self.path}/{name}")

    def materialize_observed(self, rows: DataFrame, name: str,
                             values: dict[str, Column]) -> tuple[DataFrame, dict]:
        """``materialize`` with aggregates of the rows from the same pass."""
        path = f"{self.path}/{name}"
        facts = observed_write(rows, values, lambda frame: frame.write.parquet(path))
        return rows.sparkSession.read.schema(rows.schema).parquet(path), facts


def observed_write(rows: DataFrame, values: dict[str, Column], write: Callable[[DataFrame], None]) -> dict:
    """Write rows and return aggregates of what was written, without another job.

    They are gathered by the tasks that write, after the last shuffle, so a task that is
    run again counts once.
    """
    seen = Observation()
    write(rows.observe(seen, *[value.alias(name) for name, value in values.items()]))
    return seen.get


def write_and_read(rows: DataFrame, path: str) -> DataFrame:
    """Write rows once and read them back, so that several steps can use them
    without computing them again and a lost executor costs no recomputation."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Scratch tables of this application that have not been removed, in the order written.
_kept: list[str] = []


def materialize(rows: DataFrame, label: str) -> DataFrame:
    """``write_and_read`` under a new path that stays, unless it is written inside
    ``temporary_tables``."""
    path = scratch_path(rows.sparkSession, label)
    table = write_and_read(rows, path)
    table._scratch_path = path
    _kept.append(path)
    return table


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the tables that ``materialize`` wrote meanwhile, but for those that were passed
    to the yielded function: a result that has been written needs no others."""
    start, stay = len(_kept), set()

    def keep(table: DataFrame) -> DataFrame:
        stay.add(table._scratch_path)
        return table

    yield keep
    for path in [path for path in _kept[start:] if path not in stay]:
        remove(spark, path)
        _kept.remove(path)
