"""Reports on goals: scorers, months, single matches, clean sheets, efficiency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.calendar import month_name
from touchline.functions.rounding import mean
from touchline.operators.appearances import appearances, goal_lines
from touchline.tables import MatchTables

MIN_PLAYED = 5


def venue_averages(rows: DataFrame) -> DataFrame:
    """Per team: goals, games and average goals, in all, at home and away."""
    home, away = F.col("venue") == "home", F.col("venue") == "away"

    def mean_where(side):
        return mean(F.when(side, F.col("gf")))

    return rows.groupBy("team_id").agg(
        mean("gf").alias("avg_goals"),
        mean_where(home).alias("avg_home"),
        mean_where(away).alias("avg_away"),
        F.sum("gf").alias("total_goals"),
        F.count("*").alias("played"),
    )


def best_attacks(tables: MatchTables, lines: DataFrame, limit: int) -> DataFrame:
    scored = venue_averages(lines).filter(F.col("played") >= MIN_PLAYED)
    return (
        tables.named(scored)
        .orderBy(F.desc("avg_goals"), "team_id")
        .limit(limit)
        .select("team", "avg_goals", "avg_home", "avg_away", "total_goals", "played")
    )


def top_scoring_teams(tables: MatchTables, code: str | None = None, limit: int = 10) -> DataFrame:
    """Teams by average goals per match; metrics are not needed."""
    return best_attacks(tables, goal_lines(tables, code), limit)


def monthly_goals(facts: DataFrame) -> DataFrame:
    """Matches and goals per calendar month, all years together."""
    return facts.groupBy(F.col("match_month").alias("month")).agg(
        F.count("*").alias("matches"),
        mean("total_goals").alias("avg_goals"),
        F.sum("total_goals").alias("total_goals"),
    )


def goals_by_month(tables: MatchTables, code: str | None = None) -> DataFrame:
    return (
        monthly_goals(tables.in_league(tables.facts, code))
        .select("month", month_name(F.col("month")).alias("month_name"),
                "matches", "avg_goals", "total_goals")
        .orderBy("month")
    )


def leading_matches(tables: MatchTables, matches: DataFrame, order: list[str],
                    limit: int) -> DataFrame:
    """The first matches by ``order`` descending, with both teams' names.

    Only matches whose teams are known count. The leaders are found before any
    name is joined: if all of them have known teams, the last one is the bar
    that every other match must reach, and two joins of a handful of rows are
    left. Otherwise there is no bar and all matches are joined.
    """
    def with_names(rows: DataFrame) -> DataFrame:
        return tables.named(
            tables.named(rows, "home_team_id", "home_team"), "away_team_id", "away_team"
        )

    key = F.struct(*order)
    down = [F.desc(name) for name in order]
    leaders = with_names(matches.select(*order, "home_team_id", "away_team_id")
                         .orderBy(*down).limit(limit))
    bar = leaders.agg(
        F.when(F.count("*") >= limit, F.min(key)).alias("bar")
    ).scalar()
    return with_names(matches.filter(bar.isNull() | (key >= bar))).orderBy(*down).limit(limit)


def high_scoring_matches(tables: MatchTables, code: str | None = None,
                         limit: int = 10) -> DataFrame:
    """Matches with the most goals, later ones first among equals."""
    matches = tables.in_league(tables.facts, code)
    order = ["total_goals", "match_date", "match_id"]
    return leading_matches(tables, matches, order, limit).select(
        F.col("match_date").alias("date"),
        "home_team",
        F.col("home_score_ft").alias("home_goals"),
        F.col("away_score_ft").alias("away_goals"),
        "away_team",
        "total_goals",
        "competition",
    )


def most_clean_sheets(tables: MatchTables, rows: DataFrame, limit: int) -> DataFrame:
    kept = rows.filter(F.col("clean_sheet") == 1)
    counted = kept.groupBy("team_id").agg(F.count("*").alias("clean_sheets"))
    return (
        tables.named(counted)
        .orderBy(F.desc("clean_sheets"), "team_id")
        .limit(limit)
        .select("team", "clean_sheets")
    )


def clean_sheet_leaders(tables: MatchTables, code: str | None = None,
                        limit: int = 10) -> DataFrame:
    """Teams by matches without conceding; teams without any are absent."""
    return most_clean_sheets(tables, appearances(tables, code), limit)


def efficiency_matrix(tables: MatchTables, code: str | None = None) -> DataFrame:
    """Goals for and against and points per game, per team and competition."""
    per_team = (
        appearances(tables, code)
        .groupBy("team_id", "competition")
        .agg(
            F.count("*").alias("played"),
            mean("gf").alias("goals_for_pg"),
            mean("ga").alias("goals_against_pg"),
            mean("points").alias("points_pg"),
        )
        .filter(F.col("played") >= MIN_PLAYED)
    )
    return (
        tables.named(per_team)
        .orderBy(F.desc("points_pg"), "team_id", "competition")
        .select("competition", "team", "played",
                "goals_for_pg", "goals_against_pg", "points_pg")
    )
