"""Reports shaped for display: heads of groups, pivots, labels, formatted figures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.plans.sequences import CONGESTED, RESTED
from touchline.tables import MatchTables

# Display labels per report column.
STANDINGS_LABELS = {
    "position": "Pos", "team": "Team", "played": "P", "won": "W", "drawn": "D",
    "lost": "L", "gf": "GF", "ga": "GA", "gd": "GD", "pts": "Pts",
}
FORM_LABELS = {
    "team": "Team", "form": "Form", "wins": "W",
    "draws": "D", "losses": "L", "points": "Pts",
}
SPLITS_LABELS = {
    "home_win_pct": "Home win %", "away_win_pct": "Away win %", "draw_pct": "Draw %",
}
BOUNCE_BACK_LABELS = {
    "competition": "League", "team": "Team", "games_after_loss": "Games",
    "bounce_back_ppg": "PPG after loss", "overall_ppg": "Baseline PPG",
    "resilience_delta": "Δ",
}
SOLIDITY_LABELS = {
    "competition": "League", "team": "Team", "games_vs_top": "Games vs top 5",
    "conceded_vs_top": "Conceded vs top 5", "conceded_vs_bottom": "Conceded vs bottom 5",
    "clean_sheet_pct_vs_top": "Clean sheet % vs top 5",
}


def standings_top_n(standings: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows of each competition's table."""
    top = Window.partitionBy("competition").orderBy("position", "competition_code", "team")
    return (
        standings.withColumn("line", F.row_number().over(top))
        .filter(F.col("line") <= n)
        .drop("line")
        .orderBy("competition", "position", "competition_code", "team")
    )


def form_top(form: DataFrame, n: int = 15) -> DataFrame:
    return form.orderBy(F.desc("points"), F.desc("wins"), "team").limit(n)


def rest_band_pivot(density: DataFrame) -> DataFrame:
    """Win percentage per competition, one column per band of rest."""
    return (
        density.groupBy("competition")
        .pivot("rest_band", [CONGESTED, RESTED])
        .agg(F.first("win_pct"))
        .orderBy("competition")
    )


def parity_pivot(balance: DataFrame, names: Iterable[str] | DataFrame) -> DataFrame:
    """Spread of points per matchweek, one column per competition.

    ``names`` are the columns: a list, or the table of competitions (``name``), which has a
    row per league. The report itself runs once; a competition of it that has no column is
    an error when it does.
    """
    if isinstance(names, DataFrame):
        names = sorted(row["name"] for row in names.select("name").distinct().collect())
    names = list(names)
    unknown = F.concat(F.lit("No column for "), F.col("competition"))
    checked = F.when(F.col("competition").isin(names), F.col("competition")).otherwise(
        F.raise_error(unknown).cast("string"))
    balance = balance.withColumn("competition", checked)
    return (
        balance.groupBy("matchweek")
        .pivot("competition", names)
        .agg(F.first("points_stdev"))
        .orderBy("matchweek")
    )


def splits_chart(splits: DataFrame) -> DataFrame:
    return splits.select("competition", *_labelled(SPLITS_LABELS))


def standings_view(standings: DataFrame) -> DataFrame:
    """One league's table under its display labels, or all leagues' with their name."""
    return standings.select("competition", *_labelled(STANDINGS_LABELS))


def form_view(form: DataFrame, n: int = 15) -> DataFrame:
    return form_top(form, n).select(*_labelled(FORM_LABELS))


def bounce_back_view(rated: DataFrame) -> DataFrame:
    return rated.select(*_labelled(BOUNCE_BACK_LABELS))


def solidity_view(rated: DataFrame) -> DataFrame:
    return rated.select(*_labelled(SOLIDITY_LABELS))


def kpi_format(summary: DataFrame) -> DataFrame:
    """Headline figures as text: grouped count, two decimals, whole percents."""
    def whole_percent(name: str):
        # Halves go to the even number.
        return F.concat(F.bround(name, 0).cast("bigint").cast("string"), F.lit("%"))

    return summary.select(
        F.format_number("matches", 0).alias("matches"),
        F.format_string("%.2f", "avg_goals").alias("avg_goals"),
        whole_percent("home_win_pct").alias("home_wins"),
        whole_percent("away_win_pct").alias("away_wins"),
        whole_percent("draw_pct").alias("draws"),
    )


def league_code_for_name(tables: MatchTables, name: str) -> DataFrame:
    """The code behind a league's name, for the league filter."""
    return tables.competitions.filter(F.col("name") == name).select("code")


def schedule_completeness(tables: MatchTables, code: str | None = None) -> DataFrame:
    """How much of a double round robin each league has played.

    Every ordered pair of teams is expected once. The pairs are counted, not
    listed: n·(n−1) expected against the distinct pairs seen.
    """
    matches = tables.in_league(tables.results, code)
    league = ["competition_id", "competition"]
    sides = matches.withColumn("team_id", F.explode(F.array("home_team_id", "away_team_id")))
    teams = sides.select(*league, "team_id").distinct().groupBy(*league).agg(
        F.count("*").alias("teams")
    )
    pairs = (
        matches.filter(F.col("home_team_id") != F.col("away_team_id"))
        .select("competition_id", "home_team_id", "away_team_id")
        .distinct()
        .groupBy("competition_id")
        .agg(F.count("*").alias("seen"))
    )
    expected = F.col("teams") * (F.col("teams") - 1)
    played = F.coalesce("seen", F.lit(0))
    return teams.join(pairs, "competition_id", "left").select(
        "competition",
        "teams",
        expected.alias("expected_pairs"),
        played.alias("played_pairs"),
        (expected - played).alias("missing_pairs"),
    ).orderBy("competition")


def _labelled(labels: dict[str, str]):
    return [F.col(name).alias(label) for name, label in labels.items()]
