"""Ordered computations per team that survive one very large team.

A window over all games of a team would put them into one task. Every team is
therefore cut the same way, by the calendar and by match id: a slice is one
day and one block of 2**22 ids in it. Match ids are unique, so no slice can
hold more games than that, whatever the team, the day or the spread of ids.
Windows over games run inside a slice. What one slice hands to the next is
worked out over one row per slice inside a month, and over one row per month
for the whole history, so no step depends on how large a team is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block is 2**BLOCK_BITS match ids: the most games a slice can hold.
BLOCK_BITS = 22
#: The same where the games of a slice are put into one row.
RUN_BITS = 12

SLICE = ["day", "block"]
_BEFORE = Window.unboundedPreceding, -1
# Matches without a date come first, as they do in any ascending order.
_NO_DATE = -(2**31)


def with_slices(rows: DataFrame, bits: int | None = None) -> DataFrame:
    """Add ``month``, ``day`` and ``block``, which rise with (match_date, match_id)."""
    date = F.col("match_date")
    return rows.withColumns({
        "month": F.coalesce(F.year(date) * 12 + F.month(date), F.lit(_NO_DATE)),
        "day": F.coalesce(F.unix_date(date), F.lit(_NO_DATE)),
        # Never null, so that no filter on it sets two readings of the same slices apart.
        "block": F.coalesce(F.shiftright("match_id", BLOCK_BITS if bits is None else bits), F.lit(0)),
    })


def in_slice(*key: str):
    """Window over one key's games within one slice."""
    return Window.partitionBy(*key, *SLICE).orderBy("match_id")


def before_slice(slices: DataFrame, key: list[str], fold: Callable[[str, Column], Column],
                 plus: Callable[[Column, Column], Column]) -> DataFrame:
    """What all earlier slices of a key come to, per slice; null when there are none.

    ``slices`` holds one row per key and slice. ``fold(value, position)`` is an
    aggregate, ``plus(earlier, later)`` puts two of its results together.
    """
    values = [name for name in slices.columns if name not in (*key, "month", *SLICE)]
    at = F.struct(*SLICE)
    months = slices.groupBy(*key, "month").agg(*[fold(name, at).alias(name) for name in values])
    history = Window.partitionBy(*key).orderBy("month").rowsBetween(*_BEFORE)
    months = months.select(
        *key, "month",
        *[fold(name, F.col("month")).over(history).alias(f"{name}_months") for name in values],
    )
    inside = Window.partitionBy(*key, "month").orderBy(*SLICE).rowsBetween(*_BEFORE)
    sofar = slices.withColumns({f"{name}_days": fold(name, at).over(inside) for name in values})
    return sofar.join(months, [*key, "month"]).select(
        *key, *SLICE,
        *[plus(F.col(f"{name}_months"), F.col(f"{name}_days")).alias(f"{name}_before")
          for name in values],
    )


def previous_value(rows: DataFrame, value: str, into: str) -> DataFrame:
    """Add the team's previous ``value`` in (match_date, match_id) order, null for its first."""
    cut = with_slices(rows)
    ends = cut.groupBy("team_id", "month", *SLICE).agg(F.max_by(value, "match_id").alias("end"))
    handed = before_slice(ends, ["team_id"], F.max_by, lambda earlier, later: F.coalesce(later, earlier))
    local = in_slice("team_id")
    return (
        cut.withColumns({"game": F.row_number().over(local), "before": F.lag(value).over(local)})
        .join(handed, ["team_id", *SLICE])
        .withColumn(into, F.when(F.col("game") == 1, F.col("end_before")).otherwise(F.col("before")))
        .select(*rows.columns, into)
    )


def rest_days(rows: DataFrame) -> DataFrame:
    """Add days since the team's previous game, null for its first."""
    dated = previous_value(rows, "match_date", "previous_date")
    return dated.withColumn(
        "rest_days", F.datediff("match_date", "previous_date").cast("bigint")
    ).drop("previous_date")


def preceded_by_loss(rows: DataFrame) -> DataFrame:
    """Add 1 when the team lost its previous game, 0 when not, null for its first."""
    return previous_value(rows, "l", "preceded_by_loss")


def rest_totals(rows: DataFrame, band: Callable[[Column], Column], into: str,
                *sums: str) -> DataFrame:
    """Games and sums per competition and band of rest; games in no band are left out.

    Same meaning as grouping over ``rest_days``, without a row per game in any
    window: a day's games are folded first, and all but the first have no rest.
    """
    daily = rows.groupBy("team_id", "match_date", "competition_id").agg(
        F.count("*").alias("games"),
        F.min("match_id").alias("first_id"),
        *[F.sum(name).alias(name) for name in sums],
        *[F.min_by(name, "match_id").alias(f"first_{name}") for name in sums],
    )
    # A team has one row per day and competition here: bounded by the calendar.
    order = Window.partitionBy("team_id").orderBy("match_date", "first_id")
    rest = F.datediff("match_date", F.lag("match_date").over(order))
    same_day = F.datediff("match_date", "match_date")

    def later(name: str) -> Column:
        return F.col(name) - F.coalesce(F.col(f"first_{name}"), F.lit(0))

    def part(days: Column, games: Column, value: Callable[[str], Column]) -> Column:
        return F.struct(band(days).alias(into), games.cast("bigint").alias("games"),
                        *[value(name).alias(name) for name in sums])

    parts = F.array(
        part(F.col("first_rest"), F.lit(1), lambda name: F.col(f"first_{name}").cast("bigint")),
        part(same_day, F.col("games") - 1, later),
    )
    return (
        daily.withColumn("first_rest", rest)
        .select("competition_id", F.inline(parts))
        .filter(F.col(into).isNotNull() & (F.col("games") > 0))
        .groupBy("competition_id", into)
        .agg(*[F.sum(name).alias(name) for name in ("games", *sums)])
    )


def _join_parts(parts: DataFrame, into: list[str], order: list[str]) -> DataFrame:
    """Put the parts of a team's history together, to one row per ``into`` and competition.

    A part does not know whether its first game (``head``) came after a loss:
    the last game (``end``) of the part before it tells. One row of a part has
    its head and one its end.
    """
    at = F.struct(*order)
    before = Window.partitionBy(*into).orderBy(*order, F.desc("head_games")).rowsBetween(*_BEFORE)
    handed = F.last("end", ignorenulls=True).over(before)
    known = F.col("handed").isNotNull()
    carry = F.coalesce(F.col("handed"), F.lit(0))
    return (
        parts.withColumns({"handed": handed, "last_at": F.max(at).over(Window.partitionBy(*into))})
        .groupBy(*into, "competition")
        .agg(
            F.sum("games").alias("games"),
            F.sum("points").alias("points"),
            F.sum(F.col("after_games") + carry * F.col("head_games")).alias("after_games"),
            F.sum(F.col("after_points") + carry * F.col("head_points")).alias("after_points"),
            F.sum(F.when(known, 0).otherwise(F.col("head_games"))).alias("head_games"),
            F.sum(F.when(known, 0).otherwise(F.col("head_points"))).alias("head_points"),
            F.max(F.when(at == F.col("last_at"), F.col("end"))).alias("end"),
        )
    )


def after_loss(rows: DataFrame) -> DataFrame:
    """Per team and league: games and points right after a loss, next to the
    team's games and points in all leagues.

    Same meaning as summing over ``preceded_by_loss``, folded by slice, month
    and team: nothing has to be joined back to the games, which are read once.
    """
    local = in_slice("team_id")
    first, lost_before = F.col("game") == 1, F.col("lost_before") == 1
    games = with_slices(rows).withColumns({
        "game": F.row_number().over(local),
        "lost_before": F.lag("l").over(local),
        "next_id": F.lead("match_id").over(local),
    })
    slices = games.groupBy("team_id", "month", *SLICE, "competition").agg(
        F.count("*").alias("games"),
        F.sum("points").alias("points"),
        F.count_if(lost_before).alias("after_games"),
        F.sum(F.when(lost_before, F.col("points")).otherwise(0)).alias("after_points"),
        F.count_if(first).alias("head_games"),
        F.sum(F.when(first, F.col("points")).otherwise(0)).alias("head_points"),
        F.max(F.when(F.col("next_id").isNull(), F.coalesce("l", F.lit(0)))).alias("end"),
    )
    months = _join_parts(slices, ["team_id", "month"], SLICE)
    whole_team = Window.partitionBy("team_id")
    return _join_parts(months, ["team_id"], ["month"]).select(
        "team_id", "competition", "after_games", "after_points",
        F.sum("games").over(whole_team).alias("all_games"),
        F.sum("points").over(whole_team).alias("all_points"),
    )


def running_points(rows: DataFrame) -> DataFrame:
    """Add the game's number and the team's points up to it, per league and team.

    The games of a slice become one row: numbered and summed up in order, as an array. What
    comes before a slice is worked out over these rows and joined to them, so the games are
    read and shuffled once and nothing is joined back to them. Slices are small enough for
    a row here, whatever the team.
    """
    key = ["competition_id", "team_id"]
    local = in_slice(*key)
    so_far = F.sum("points").over(local.rowsBetween(Window.unboundedPreceding, 0))
    games = with_slices(rows, min(BLOCK_BITS, RUN_BITS)).withColumns(
        {"game": F.row_number().over(local), "so_far": so_far})
    others = [name for name in rows.columns if name not in key]
    runs = games.groupBy(*key, "month", *SLICE).agg(
        F.sort_array(F.collect_list(F.struct("game", "so_far", *others))).alias("run"))
    last = F.element_at("run", -1)
    sums = runs.select(*key, "month", *SLICE, F.col("run")).select(
        *key, "month", *SLICE, last["game"].alias("games"), last["so_far"].alias("sum"))
    none = F.lit(0)
    handed = before_slice(sums, key, lambda name, at: F.sum(name),
                          lambda earlier, later: F.coalesce(earlier, none) + F.coalesce(later, none))
    return (
        runs.drop("month").join(handed, [*key, *SLICE])
        .select(*key, "games_before", "sum_before", F.inline("run"))
        .withColumn("matchweek", F.col("game") + F.col("games_before"))
        .withColumn("cumulative_points", F.col("so_far") + F.col("sum_before"))
        .select(*rows.columns, "matchweek", "cumulative_points")
    )
