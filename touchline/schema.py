"""Schemas and fixed values of the data model.

Every integer column is BIGINT and every 0/1 flag is BIGINT as well: the
reports sum flags, and Spark does not sum booleans.
"""

from pyspark.sql import types as T

LONG, TEXT, DAY = T.LongType(), T.StringType(), T.DateType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Score fields are read as text so that a bad value can become 0 rather than
# turn the whole match into a corrupt record.
_SIDES = _struct(home=TEXT, away=TEXT)

# Field names and types of the feed.
RAW_MATCH = _struct(
    id=LONG,
    competition=_struct(code=TEXT, name=TEXT),
    season=_struct(startDate=TEXT, endDate=TEXT),
    utcDate=TEXT,
    status=TEXT,
    matchday=LONG,
    homeTeam=_struct(id=LONG, name=TEXT),
    awayTeam=_struct(id=LONG, name=TEXT),
    score=_struct(fullTime=_SIDES, halfTime=_SIDES, winner=TEXT),
    referees=T.ArrayType(_struct(name=TEXT, type=TEXT)),
)

# One response of the feed: an envelope around many matches.
ENVELOPE = _struct(matches=T.ArrayType(RAW_MATCH))

# Statuses that carry a final result.
COMPLETED_STATUSES = ("FINISHED", "AWARDED")

# The order in which league snapshots are merged, last one wins.
LEAGUE_ORDER = ("PL", "PD", "BL1", "SA", "FL1")

# Fixed value: goals from which a match counts as high scoring.
HIGH_SCORE_THRESHOLD = 4

SCORES = ("home_score_ft", "away_score_ft", "home_score_ht", "away_score_ht")

# The derived metrics of one match.
METRICS = (
    "total_goals",
    "goal_differential",
    "home_win",
    "away_win",
    "is_draw",
    "both_teams_scored",
    "clean_sheet_home",
    "clean_sheet_away",
    "high_scoring",
    "halftime_home_lead",
    "halftime_away_lead",
    "comeback_home",
    "comeback_away",
    "second_half_goals",
    "match_month",
    "match_weekday",
)

# Columns of the normalized tables.
COMPETITIONS = _struct(id=LONG, code=TEXT, name=TEXT)

TEAMS = _struct(id=LONG, name=TEXT)

MATCHES = _struct(
    id=LONG,
    competition_id=LONG,
    home_team_id=LONG,
    away_team_id=LONG,
    match_date=DAY,
    matchday=LONG,
    status=TEXT,
    home_score_ft=LONG,
    away_score_ft=LONG,
    home_score_ht=LONG,
    away_score_ht=LONG,
    winner=TEXT,
    referee=TEXT,
)

MATCH_METRICS = _struct(match_id=LONG, **{name: LONG for name in METRICS})

# A match with its metrics on one row: how the store keeps both tables.
MATCH_FACTS = T.StructType(MATCHES.fields + MATCH_METRICS.fields[1:])
