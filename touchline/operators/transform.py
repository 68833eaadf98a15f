"""Raw matches → clean matches with metrics, plus the teams and leagues in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.calendar import parse_utc, utc_day
from touchline.functions.metrics import match_metrics
from touchline.schema import COMPLETED_STATUSES, HIGH_SCORE_THRESHOLD, SCORES

# Position of a match in its feed; decides which of several copies is "first".
ORDINAL = "ordinal"


def normalize_matches(raw: DataFrame) -> DataFrame:
    """Flatten nested matches to eighteen columns (and keep the ordinal, if any)."""
    flat = raw.select(
        F.col("id").alias("match_id"),
        F.col("competition.code").alias("competition_code"),
        F.col("competition.name").alias("competition_name"),
        F.col("season.startDate").alias("season_start"),
        F.col("season.endDate").alias("season_end"),
        F.col("utcDate").alias("utc_date"),
        "status",
        "matchday",
        F.col("homeTeam.id").alias("home_team_id"),
        F.col("homeTeam.name").alias("home_team_name"),
        F.col("awayTeam.id").alias("away_team_id"),
        F.col("awayTeam.name").alias("away_team_name"),
        F.col("score.fullTime.home").alias("home_score_ft"),
        F.col("score.fullTime.away").alias("away_score_ft"),
        F.col("score.halfTime.home").alias("home_score_ht"),
        F.col("score.halfTime.away").alias("away_score_ht"),
        F.col("score.winner").alias("winner"),
        F.get("referees", F.lit(0)).getField("name").alias("referee"),
        *([ORDINAL] if ORDINAL in raw.columns else []),
    )
    return flat


def completed_only(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("status").isin(*COMPLETED_STATUSES))


def drop_incomplete(matches: DataFrame) -> DataFrame:
    """Leave out matches without a readable date or without a full-time score."""
    return matches.dropna(subset=["home_score_ft", "away_score_ft", "utc_date"])


def coerce_scores(matches: DataFrame) -> DataFrame:
    """Scores to whole numbers: decimals are cut, anything unreadable is 0."""
    def whole(name: str):
        number = F.nanvl(F.col(name).try_cast("double"), F.lit(0.0))
        return F.coalesce(number.try_cast("bigint"), F.lit(0)).cast("bigint")

    return matches.withColumns({name: whole(name) for name in SCORES})


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; null is a key like any other.

    ``row_number() = 1`` plans as a group limit before the shuffle: each task
    forwards at most one row per key, however many rows a key has.
    """
    first = Window.partitionBy(key).orderBy(*order)
    return (
        rows.withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") == 1)
        .drop("nth")
    )


def dedupe_matches(matches: DataFrame) -> DataFrame:
    """One row per match id, the first in feed order; null ids count as one id."""
    return first_per_key(matches, "match_id", [ORDINAL])


def clean_matches(matches: DataFrame) -> DataFrame:
    dated = matches.withColumn("utc_date", parse_utc(F.col("utc_date")))
    return dedupe_matches(coerce_scores(drop_incomplete(completed_only(dated))))


def derive_metrics(matches: DataFrame, threshold: int = HIGH_SCORE_THRESHOLD) -> DataFrame:
    """Add the sixteen metrics; needs scores, ``winner`` and ``match_date``."""
    return matches.withColumns(match_metrics(threshold))


def transform_matches(raw: DataFrame, threshold: int = HIGH_SCORE_THRESHOLD) -> DataFrame:
    """The whole chain from raw to clean, dated and measured matches.

    Needs the column ``ordinal`` that ``read_matches_json`` adds: it decides which
    of several copies of a match comes first.
    """
    if ORDINAL not in raw.columns:
        raise ValueError(f"Raw matches need the column {ORDINAL!r}; see read_matches_json.")
    clean = clean_matches(normalize_matches(raw))
    return derive_metrics(clean.withColumn("match_date", utc_day(F.col("utc_date"))), threshold)


def _feed_order(matches: DataFrame) -> Column:
    """Without feed positions the smallest match id stands for the first match."""
    place = ORDINAL if ORDINAL in matches.columns else "match_id"
    return F.col(place).alias("place")


def extract_teams(matches: DataFrame) -> DataFrame:
    """Unique teams. A name seen on the home side beats one seen on the away side."""
    sides = matches.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    home = F.col("side") == 0
    rows = sides.select(
        F.when(home, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("team_id"),
        F.when(home, F.col("home_team_name")).otherwise(F.col("away_team_name")).alias("team_name"),
        "side",
        _feed_order(matches),
    )
    return first_per_key(rows, "team_id", ["side", "place"]).select("team_id", "team_name")


def extract_competitions(matches: DataFrame) -> DataFrame:
    """Unique competitions, first name per code, ids 1..n in code order."""
    rows = matches.select("competition_code", "competition_name", _feed_order(matches))
    named = first_per_key(rows, "competition_code", ["place"])
    # One row per league reaches this window.
    by_code = Window.orderBy("competition_code")
    return named.select(
        F.row_number().over(by_code).cast("bigint").alias("id"),
        F.col("competition_code").alias("code"),
        F.col("competition_name").alias("name"),
    )


def run_summary(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Counts of one run: transformed matches, teams and competitions."""
    counted = matches.agg(
        F.count("*").alias("matches"),
        F.countDistinct("competition_code").alias("competitions"),
    )
    team_count = teams.agg(F.count("*")).scalar()
    return counted.select("matches", team_count.alias("teams"), "competitions")
