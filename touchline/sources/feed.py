"""Reading landed feed responses as raw matches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.schema import ENVELOPE, RAW_MATCH
from touchline.sources.paths import exists

CORRUPT = "_unreadable"


#: A response with its own text where it is not valid JSON.
KEPT = T.StructType([*ENVELOPE.fields, T.StructField(CORRUPT, T.StringType())])
_LEAGUE = T.StructField("league", T.StringType())


def _responses(spark: SparkSession, paths: str | list[str], multi_line: bool,
               league: str | None = None) -> DataFrame:
    """Landed responses; of those under ``league=<code>`` folders one league's alone, if
    named: the folder is a partition, so no file of another league is listed for reading."""
    read = spark.read.schema(T.StructType([*KEPT.fields, _LEAGUE]) if league else KEPT)
    rows = (
        read.option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(paths)
    )
    return rows.filter(F.col("league") == league).drop("league") if league else rows


def unreadable(responses: DataFrame) -> Column:
    """Whether a response is not valid JSON."""
    # Spark wants another column to be read beside the unreadable text.
    return F.col(CORRUPT).isNotNull() & (F.coalesce(F.size(responses["matches"]), F.lit(0)) >= -1)


def unreadable_responses(spark: SparkSession, paths: str | list[str],
                         multi_line: bool = False) -> DataFrame:
    """``file`` and ``response`` of every response that is not valid JSON."""
    return unreadable_of(_responses(spark, paths, multi_line))


def unreadable_of(responses: DataFrame) -> DataFrame:
    """``file`` and ``response`` of the unreadable ones among read responses."""
    return responses.filter(unreadable(responses)).select(
        F.col("_metadata.file_path").alias("file"), F.col(CORRUPT).alias("response"))


def read_matches_json(spark: SparkSession, paths: str | list[str], multi_line: bool = False,
                      strict: bool = False, codes: Iterable[str] = (),
                      league: str | None = None, bad: Observation | None = None) -> DataFrame:
    """Matches of all responses, each with its position in the feed.

    One response per line splits across tasks; pretty-printed files need
    ``multi_line`` and are read one file per task. An unreadable response
    yields no matches and does not fail the rest, see ``unreadable_responses``;
    with ``strict`` it is an error. ``league`` reads the files under ``league=<code>``
    alone. ``bad`` counts the unreadable responses (``unreadable``) in the pass that reads.
    """
    if strict and (lost := unreadable_responses(spark, paths, multi_line).count()):
        raise ValueError(f"{lost} unreadable responses")
    responses = _responses(spark, paths, multi_line, league)
    if bad is not None:
        responses = responses.observe(bad, F.count_if(unreadable(responses)).alias("unreadable"))
    return unpack_responses(responses, codes)


def unpack_responses(responses: DataFrame, codes: Iterable[str] = ()) -> DataFrame:
    """One row per match of each envelope, with ``ordinal`` for first-wins rules.

    Leagues come in the order of ``codes`` when their files lie under ``league=<code>``.
    Lines of one file block are read in order by one task, so the generated id
    only has to order lines inside a block; file and block order the rest.
    """
    placed = responses.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.posexplode("matches").alias("pos", "match"),
    )
    fields = [F.col(f"match.{name}").alias(name) for name in RAW_MATCH.names]
    rank = F.lit(0)
    for place, code in reversed(list(enumerate(codes))):
        rank = F.when(F.col("file").contains(f"/league={code}/"), F.lit(place)).otherwise(rank)
    ordinal = F.struct(rank.alias("league"), "file", "block", "line",
                       F.col("pos").cast("bigint").alias("pos"))
    return placed.select(*fields, ordinal.alias("ordinal"))


def union_leagues(spark: SparkSession, base: str, codes: Iterable[str],
                  multi_line: bool = False) -> DataFrame:
    """Matches of all given leagues under ``base/league=<code>``.

    A league that has not landed is skipped and the others still load. Of a match
    that several leagues have, the copy of the league named first comes first.
    """
    codes = list(codes)
    landed = [f"{base}/league={code}" for code in codes]
    present = [path for path in landed if exists(spark, path)]
    if not present:
        empty = spark.createDataFrame([], RAW_MATCH)
        nowhere = F.struct(
            F.lit(0).alias("league"),
            F.lit("").alias("file"),
            *[F.lit(0).cast("bigint").alias(part) for part in ("block", "line", "pos")],
        )
        return empty.withColumn("ordinal", nowhere)
    return read_matches_json(spark, present, multi_line, codes=codes)


def league_scope(raw: DataFrame, code: str | None) -> DataFrame:
    """One named league, or everything when no league is named."""
    return raw if not code else raw.filter(F.col("competition.code") == code)


def season_scope(raw: DataFrame, season: int | None) -> DataFrame:
    """Matches of the season that starts in the given year; all when none is given."""
    if not season:
        return raw
    start = F.col("season.startDate").try_cast("date")
    return raw.filter(F.year(start) == season)
