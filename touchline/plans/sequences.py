"""Reports on the order of games and the strength of opponents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.rounding import (
    folded_mean, percent, population_stdev, ratio, ratio_minus_rounded, with_known)
from touchline.operators.appearances import appearances, goal_lines
from touchline.operators.ranking import rank_within
from touchline.operators.slices import after_loss, rest_totals, running_points
from touchline.tables import MatchTables

# The two bands of rest and their labels.
CONGESTED, RESTED = "Congested (<4d)", "Rested (6+d)"
CONGESTED_BELOW, RESTED_FROM = 4, 6

# Sizes of the attack tiers and smallest samples.
TIER_SIZE = 5
MIN_AFTER_LOSS = 3
MIN_VS_TOP = 2
MIN_TEAMS = 2


def rest_band(days: Column) -> Column:
    """Congested, rested, or null for anything in between and for no rest known."""
    return F.when(days < CONGESTED_BELOW, CONGESTED).when(days >= RESTED_FROM, RESTED)


def schedule_density(tables: MatchTables, code: str | None = None) -> DataFrame:
    """Results on little and on much rest, per competition."""
    games = appearances(tables, code).withColumn("won_points", F.col("w") * 3 + F.col("d"))
    measures = ["won_points", "gf"]
    by_band = rest_totals(with_known(games, *measures), rest_band, "rest_band", "w", *measures,
                          *[f"known_{name}" for name in measures])
    n = F.sum("games")
    return (
        tables.in_league(by_band)
        .groupBy("competition", "rest_band")
        .agg(
            n.alias("matches"),
            percent(F.sum("w"), n).alias("win_pct"),
            folded_mean("won_points").alias("ppg"),
            folded_mean("gf").alias("avg_goals_for"),
        )
        .orderBy("competition", "rest_band")
    )


def baseline_ppg(tables: MatchTables, code: str | None = None) -> DataFrame:
    """Points per game of each team over all its games."""
    return appearances(tables, code).groupBy("team_id").agg(
        ratio(F.sum("points"), F.count("*")).alias("overall_ppg")
    )


def bounce_back(tables: MatchTables, code: str | None = None, limit: int = 10) -> DataFrame:
    """Points per game right after a loss against the team's own baseline."""
    folded = after_loss(appearances(tables, code))
    n, s = F.col("after_games"), F.col("after_points")
    all_n, all_s = F.col("all_games"), F.col("all_points")
    rated = folded.filter(n >= MIN_AFTER_LOSS).select(
        "competition",
        "team_id",
        n.alias("games_after_loss"),
        ratio(s, n).alias("bounce_back_ppg"),
        ratio(all_s, all_n).alias("overall_ppg"),
        ratio_minus_rounded(s, n, all_s, all_n).alias("resilience_delta"),
    )
    return (
        tables.named(rated)
        .orderBy(F.desc("bounce_back_ppg"), F.desc("resilience_delta"), "team_id", "competition")
        .limit(limit)
        .select("competition", "team", "games_after_loss", "bounce_back_ppg", "overall_ppg",
                "resilience_delta")
    )


def competitive_balance(tables: MatchTables, code: str | None = None) -> DataFrame:
    """Spread of cumulative points over the teams of a league, game by game."""
    # DECIMAL sums: squares of a long history's points pass the range of BIGINT.
    points = F.col("cumulative_points").cast("decimal(18,0)")
    games = appearances(tables, code).select(
        "competition_id", "team_id", "match_date", "match_id", "points")
    spread = (
        running_points(games)
        .groupBy("competition_id", "matchweek")
        .agg(
            F.count("*").alias("teams"),
            F.sum(points).cast("decimal(38,0)").alias("total"),
            F.sum(points * points).alias("squares"),
        )
        .filter(F.col("teams") >= MIN_TEAMS)
    )
    stdev = population_stdev(F.col("teams"), F.col("total"), F.col("squares"))
    return (
        tables.in_league(spread)
        .select("competition", "matchweek", "teams", stdev.alias("points_stdev"))
        .orderBy("competition", "matchweek")
    )


def pairings(tables: MatchTables, code: str | None = None) -> DataFrame:
    """Games of each team against each opponent, folded to one row."""
    key, counts = ["competition_id", "team_id", "opponent_id"], ["games", "known", "conceded", "blanks"]
    return (
        goal_lines(tables, code)
        .filter(" AND ".join(f"{name} IS NOT NULL" for name in key))
        .groupBy(*key)
        .agg(
            F.count("*").alias("games"),
            F.count("ga").alias("known"),
            F.sum("ga").alias("conceded"),
            F.count_if(F.col("ga") == 0).alias("blanks"),
        )
        # Read several times below. Naming every column each time, in a test that
        # holds for all rows, keeps the readings alike, so Spark folds the games
        # only once. Negative and unknown scores stay.
        .filter(F.hash(*counts) >= F.lit(-(2**31)))
    )


def _attack_tier(pairs: DataFrame) -> DataFrame:
    """What a team's opponents conceded is what the team scored.

    The mean is over games with a known score; a team without any comes last.
    """
    mean = F.sum("conceded") / F.nullif(F.sum("known"), F.lit(0))
    attacks = pairs.groupBy("competition_id", F.col("opponent_id").alias("team_id")).agg(
        F.coalesce(mean, F.lit(-1e9)).alias("scored")
    )
    # The grade only spreads the ranking over tasks; the order is the same.
    graded = attacks.withColumn("grade", F.floor(F.col("scored") * 256))
    ranked = rank_within(graded, ["competition_id"], ["grade", "scored"], "attack_rank")
    sizes = attacks.groupBy("competition_id").agg(F.count("*").alias("league_size"))
    return ranked.join(sizes, "competition_id").select(
        "competition_id", "team_id", "attack_rank", "league_size"
    )


def attack_tier(tables: MatchTables, code: str | None = None) -> DataFrame:
    """Rank of each team's attack in its league, and the league's size."""
    return tables.in_league(_attack_tier(pairings(tables, code))).select(
        "competition_code", "team_id", "attack_rank", "league_size"
    )


def tier_name(rank: Column, size: Column) -> Column:
    """Top or bottom five attacks; in a small league the top comes first."""
    return F.when(rank <= TIER_SIZE, "top").when(rank > size - TIER_SIZE, "bottom")


def _graded_opponents(pairs: DataFrame) -> DataFrame:
    named = _attack_tier(pairs).select(
        "competition_id",
        F.col("team_id").alias("opponent_id"),
        tier_name(F.col("attack_rank"), F.col("league_size")).alias("opponent_tier"),
    )
    return named.filter(F.col("opponent_tier").isNotNull())


def opponent_grade(tables: MatchTables, code: str | None = None) -> DataFrame:
    """Every appearance against a top or bottom attack, with that tier."""
    tiers = _graded_opponents(pairings(tables, code))
    return goal_lines(tables, code).join(tiers, ["competition_id", "opponent_id"])


def defensive_solidity(tables: MatchTables, code: str | None = None,
                       limit: int = 10) -> DataFrame:
    """Goals conceded and clean sheets against the best and the worst attacks, over the
    games whose score is known; ``games_vs_top`` counts all.

    Games are folded per pairing before the tiers are joined, so an opponent
    with very many games is one row per pairing there.
    """
    pairs = pairings(tables, code)
    graded = tables.in_league(
        pairs.join(_graded_opponents(pairs), ["competition_id", "opponent_id"])
    )
    top, bottom = F.col("opponent_tier") == "top", F.col("opponent_tier") == "bottom"

    def total(side, name):
        return F.sum(F.when(side, F.col(name)).otherwise(0))

    rated = (
        graded.groupBy("team_id", "competition")
        .agg(
            total(top, "games").alias("games_vs_top"),
            ratio(total(top, "conceded"), total(top, "known")).alias("conceded_vs_top"),
            ratio(total(bottom, "conceded"), total(bottom, "known")).alias("conceded_vs_bottom"),
            percent(total(top, "blanks"), total(top, "known")).alias("clean_sheet_pct_vs_top"),
        )
        .filter(F.col("games_vs_top") >= MIN_VS_TOP)
    )
    return (
        tables.named(rated)
        .orderBy("conceded_vs_top", F.desc("clean_sheet_pct_vs_top"), "team_id", "competition")
        .limit(limit)
        .select("competition", "team", "games_vs_top", "conceded_vs_top", "conceded_vs_bottom",
                "clean_sheet_pct_vs_top")
    )
