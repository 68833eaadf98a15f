"""The sixteen metrics of one match, each as a column expression."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.schema import HIGH_SCORE_THRESHOLD


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def match_metrics(threshold: int = HIGH_SCORE_THRESHOLD) -> dict[str, Column]:
    """Metric name → expression over scores, winner and match date.

    Outcomes follow the feed's ``winner``, not the score: an awarded match may
    have a winner that the score does not show, and a match without a winner
    has no outcome.
    """
    home, away = F.col("home_score_ft"), F.col("away_score_ft")
    home_ht, away_ht = F.col("home_score_ht"), F.col("away_score_ht")
    total = home + away
    home_win = F.col("winner") == "HOME_TEAM"
    away_win = F.col("winner") == "AWAY_TEAM"
    return {
        "total_goals": total,
        "goal_differential": home - away,
        "home_win": flag(home_win),
        "away_win": flag(away_win),
        "is_draw": flag(F.col("winner") == "DRAW"),
        "both_teams_scored": flag((home >= 1) & (away >= 1)),
        "clean_sheet_home": flag(away == 0),
        "clean_sheet_away": flag(home == 0),
        "high_scoring": flag(total >= threshold),
        "halftime_home_lead": flag(home_ht > away_ht),
        "halftime_away_lead": flag(away_ht > home_ht),
        "comeback_home": flag((away_ht > home_ht) & home_win),
        "comeback_away": flag((home_ht > away_ht) & away_win),
        "second_half_goals": F.greatest(F.lit(0), total - home_ht - away_ht).cast("bigint"),
        "match_month": F.month("match_date").cast("bigint"),
        "match_weekday": F.weekday("match_date").cast("bigint"),
    }
