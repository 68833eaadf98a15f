"""Match-shaped data derived by Spark from the order tables.

An order becomes a match: its lines decide teams and goals, its status whether
it was played. Leagues are regions, teams are suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.rounding import int_div
from touchline.operators.transform import completed_only, derive_metrics
from touchline.schema import MATCH_FACTS
from touchline.tables import MatchTables


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches, played or not, before cleaning."""
    # Sums first, so that an order with very many lines reaches the join as one
    # row; the same sums in every use, so that they are computed only once.
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_suppkey").cast("bigint").alias("a"),
        F.sum("l_partkey").cast("bigint").alias("b"),
        F.sum("l_quantity").cast("bigint").alias("q"),
        F.sum(F.col("l_quantity") * F.col("l_linenumber")).cast("bigint").alias("w"),
    ).dropna()
    n = read(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate",
        F.when(F.col("o_orderstatus") == "F", "FINISHED")
        .when(F.col("o_orderstatus") == "P", "AWARDED")
        .otherwise("SCHEDULED").alias("status"),
    )
    match_id, hs, aw = F.col("match_id"), F.col("home_score_ft"), F.col("away_score_ft")
    day = F.col("utc_date")
    step = F.lit(5) * (F.lit(1) + F.col("b") % (int_div(n, F.lit(5)) - 1))
    unknown = F.lit(None)
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.col("o_orderkey").alias("match_id"),
            F.col("o_orderdate").alias("utc_date"),
            "status",
            (F.col("a") % n).alias("home_team_id"),
            ((F.col("a") % n + step) % n).alias("away_team_id"),
            (F.col("q") % 5).alias("home_score_ft"),
            (F.col("w") % 4).alias("away_score_ft"),
        )
        .select(
            "match_id",
            "utc_date",
            (F.col("home_team_id") % 5).alias("competition_id"),
            "home_team_id",
            "away_team_id",
            F.to_date("utc_date").alias("match_date"),
            F.when(match_id % 97 == 0, unknown).otherwise(
                (F.year(day) - 1995) * 6 + F.floor((F.month(day) - 1) / 2) + 1
            ).cast("bigint").alias("matchday"),
            "status",
            "home_score_ft",
            "away_score_ft",
            F.when(match_id % 53 == 0, unknown).otherwise(F.least(hs, match_id % 3))
            .cast("bigint").alias("home_score_ht"),
            F.when(match_id % 53 == 0, unknown).otherwise(F.least(aw, (match_id + 1) % 4))
            .cast("bigint").alias("away_score_ht"),
            F.when(match_id % 89 == 0, unknown).when(hs > aw, "HOME_TEAM")
            .when(aw > hs, "AWAY_TEAM").otherwise("DRAW").alias("winner"),
        )
    )


def played_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed matches with metrics, one wide row each."""
    played = completed_only(fixture_matches(spark, sf_dir)).withColumns(
        {name: F.coalesce(name, F.lit(0)).cast("bigint")
         for name in ("home_score_ht", "away_score_ht")}
    )
    return derive_metrics(
        played.withColumn("referee", F.lit(None).cast("string")).withColumnRenamed("match_id", "id")
    ).select(*MATCH_FACTS.names)


def competitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("bigint").alias("id"),
        F.substring("r_name", 1, 2).alias("code"),
        F.col("r_name").alias("name"),
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")
    )


def tables(spark: SparkSession, sf_dir: str) -> MatchTables:
    return MatchTables.from_wide(
        competitions(spark, sf_dir), teams(spark, sf_dir), played_matches(spark, sf_dir)
    )


def unknown_scores(spark: SparkSession, sf_dir: str) -> MatchTables:
    """The tables with unknown and with negative scores, and some unknown draws."""
    mid = F.col("id")
    no_home, no_away, below, no_draw = mid % 7 == 3, mid % 11 == 4, mid % 13 == 5, mid % 19 == 6
    wide = played_matches(spark, sf_dir).withColumns({
        "home_score_ft": F.when(~no_home, F.when(below, F.lit(-2).cast("bigint")).otherwise(F.col("home_score_ft"))),
        "away_score_ft": F.when(~no_away, F.col("away_score_ft")),
        "total_goals": F.when(~(no_home | no_away), F.when(below, -F.col("total_goals")).otherwise(F.col("total_goals"))),
        "is_draw": F.when(~no_draw, F.col("is_draw")),
    })
    return MatchTables.from_wide(competitions(spark, sf_dir), teams(spark, sf_dir), wide)


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture as nested feed records, all statuses, scores as text."""
    rows = fixture_matches(spark, sf_dir)
    leagues = competitions(spark, sf_dir).select(
        F.col("id").alias("competition_id"), F.struct("code", "name").alias("competition")
    )

    def side(name: str) -> DataFrame:
        return teams(spark, sf_dir).select(
            F.col("id").alias(f"{name}_team_id"), F.struct("id", "name").alias(f"{name}Team")
        )

    def text_pair(half: str):
        return F.struct(
            F.col(f"home_score_{half}").cast("string").alias("home"),
            F.col(f"away_score_{half}").cast("string").alias("away"),
        )

    named = (
        rows.join(leagues, "competition_id")
        .join(side("home"), "home_team_id")
        .join(side("away"), "away_team_id")
    )
    year = F.year("match_date")
    return named.select(
        F.col("match_id").alias("id"),
        "competition",
        F.struct(
            F.make_date(year, F.lit(1), F.lit(1)).cast("string").alias("startDate"),
            F.make_date(year, F.lit(12), F.lit(31)).cast("string").alias("endDate"),
        ).alias("season"),
        F.date_format("utc_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utcDate"),
        "status",
        "matchday",
        "homeTeam",
        "awayTeam",
        F.struct(
            text_pair("ft").alias("fullTime"), text_pair("ht").alias("halfTime"), "winner"
        ).alias("score"),
        F.array(
            F.struct(
                F.concat(F.lit("Referee "), (F.col("match_id") % 7).cast("string")).alias("name"),
                F.lit("REFEREE").alias("type"),
            )
        ).alias("referees"),
    )


def with_ordinal(raw: DataFrame, pos="id", line=None) -> DataFrame:
    """Feed positions for records that were not read from files."""
    return raw.withColumn(
        "ordinal",
        F.struct(
            F.lit("").alias("file"),
            F.lit(0).cast("bigint").alias("block"),
            (F.lit(0) if line is None else F.col(line)).cast("bigint").alias("line"),
            F.col(pos).alias("pos"),
        ),
    )
