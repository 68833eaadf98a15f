"""The stand-alone reports: no league filter, and their own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.rounding import mean, percent
from touchline.operators.appearances import appearances, goal_lines
from touchline.plans.goals import (
    best_attacks,
    leading_matches,
    monthly_goals,
    most_clean_sheets,
)
from touchline.tables import MatchTables


def sql_standings(tables: MatchTables) -> DataFrame:
    """League tables by team id, without a position."""
    per_team = appearances(tables).groupBy("competition", "team_id").agg(
        F.count("*").alias("MP"),
        F.sum("w").alias("W"),
        F.sum("d").alias("D"),
        F.sum("l").alias("L"),
        F.sum("gf").alias("GF"),
        F.sum("ga").alias("GA"),
        (F.sum("gf") - F.sum("ga")).alias("GD"),
        (F.sum("w") * 3 + F.sum("d")).alias("Pts"),
    )
    return (
        tables.named(per_team, into="team_name")
        .orderBy("competition", F.desc("Pts"), F.desc("GD"), F.desc("GF"), "team_id")
        .select("competition", "team_name", "MP", "W", "D", "L", "GF", "GA", "GD", "Pts")
    )


def sql_top_scoring(tables: MatchTables, limit: int = 10) -> DataFrame:
    return best_attacks(tables, goal_lines(tables, league=False), limit).select(
        "team",
        F.col("avg_goals").alias("avg_goals_per_game"),
        "total_goals",
        F.col("played").alias("matches_played"),
    )


def sql_high_scoring(tables: MatchTables, limit: int = 20) -> DataFrame:
    matches = tables.in_league(tables.facts)
    order = ["total_goals", "match_date", "match_id"]
    return leading_matches(tables, matches, order, limit).select(
        "match_date", "home_team", "home_score_ft", "away_score_ft", "away_team",
        "total_goals", "competition",
    )


def sql_clean_sheets(tables: MatchTables, limit: int = 10) -> DataFrame:
    return most_clean_sheets(tables, appearances(tables, league=False), limit)


def outcome_rates(tables: MatchTables) -> DataFrame:
    """Outcomes over all matches, from the metrics alone."""
    n = F.count("*")
    wins, losses, draws = F.sum("home_win"), F.sum("away_win"), F.sum("is_draw")
    return tables.match_metrics.agg(
        n.alias("total_matches"),
        wins.alias("home_wins"),
        losses.alias("away_wins"),
        draws.alias("draws"),
        percent(wins, n).alias("home_win_pct"),
        percent(losses, n).alias("away_win_pct"),
        percent(draws, n).alias("draw_pct"),
        mean("total_goals").alias("avg_goals_per_game"),
    )


def sql_goals_by_month(tables: MatchTables) -> DataFrame:
    return monthly_goals(tables.match_metrics).orderBy("month")


def comeback_wins(tables: MatchTables, limit: int = 20) -> DataFrame:
    """Latest matches won by the side that was behind at half-time."""
    turned = tables.facts.filter((F.col("comeback_home") == 1) | (F.col("comeback_away") == 1))
    return leading_matches(tables, turned, ["match_date", "match_id"], limit).select(
        "home_team", "home_score_ht", "away_score_ht", "home_score_ft", "away_score_ft",
        "away_team", "match_date",
    )


def team_performance_summary(tables: MatchTables) -> DataFrame:
    """Everything about each team, over all leagues."""
    n = F.count("*")
    per_team = appearances(tables, league=False).groupBy("team_id").agg(
        n.alias("played"),
        F.sum("w").alias("wins"),
        F.sum("d").alias("draws"),
        F.sum("l").alias("losses"),
        F.sum("gf").alias("goals_for"),
        F.sum("ga").alias("goals_against"),
        (F.sum("gf") - F.sum("ga")).alias("goal_diff"),
        (F.sum("w") * 3 + F.sum("d")).alias("points"),
        F.sum("clean_sheet").alias("clean_sheets"),
        F.sum("btts").alias("both_scored_games"),
        percent(F.sum("w"), n).alias("win_pct"),
    )
    return tables.named(per_team).orderBy(F.desc("points"), "team_id").select(
        "team", "played", "wins", "draws", "losses", "goals_for", "goals_against",
        "goal_diff", "points", "clean_sheets", "both_scored_games", "win_pct",
    )
