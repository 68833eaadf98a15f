"""One query per operator and report, each over the whole derived match data."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixture
from touchline.functions.calendar import month_name, parse_utc, utc_day
from touchline.operators import load, merge, slices, transform
from touchline.operators.appearances import appearances, goal_lines
from touchline.pipeline import run
from touchline.plans import console, dispatch, documented, goals, outcomes, sequences, shape
from touchline.schema import MATCHES, METRICS
from touchline.sources import feed, snapshots
from touchline.sources import merged as merged_store
from touchline.sources.scratch import materialize, scratch_path
from touchline.sources.store import MatchStore
from touchline.streaming import ingest
from touchline.tables import MatchTables

Query = Callable[[SparkSession, str], DataFrame]

# The leagues of the fixture, in code order.
CODES = ["AF", "AM", "AS", "EU", "MI"]
NAMES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def over_tables(name: str, build: Callable[[MatchTables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(fixture.tables(spark, sf_dir))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.with_ordinal(fixture.raw_matches(spark, sf_dir))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.normalize_matches(_raw(spark, sf_dir))


def _transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.transform_matches(_raw(spark, sf_dir))


def _one_goal_more(matches: DataFrame, only=None) -> DataFrame:
    """The same matches with another home score, as a later version of them."""
    more = F.lit(1) if only is None else F.when(only, 1).otherwise(0)
    return matches.withColumn("home_score_ft", (F.col("home_score_ft") + more).cast("bigint"))


# Sources and sinks ---------------------------------------------------------


def _land(spark: SparkSession, sf_dir: str, by_league: bool = False) -> str:
    """Write the fixture as feed responses, one match per response."""
    raw = fixture.raw_matches(spark, sf_dir)
    path = scratch_path(spark, "landed")
    responses = raw.select(
        F.array(F.struct(*raw.columns)).alias("matches"),
        F.col("competition.code").alias("league"),
    )
    if by_league:
        responses.filter(F.col("league") != "MI").write.partitionBy("league").json(path)
    else:
        responses.drop("league").write.json(path)
    return path


@query
def read_matches_json(spark, sf_dir):
    read = feed.read_matches_json(spark, _land(spark, sf_dir))
    return transform.normalize_matches(read).drop("ordinal")


@query
def unreadable_responses(spark, sf_dir):
    """Every tenth response is cut short: how many are read and how many are not."""
    raw = fixture.raw_matches(spark, sf_dir)
    text = F.to_json(F.struct(F.array(F.struct(*raw.columns)).alias("matches")))
    cut = F.when(F.col("id") % 10 == 3, F.substring(text, 1, 40)).otherwise(text)
    path = scratch_path(spark, "landed")
    raw.select(cut.alias("value")).write.text(path)
    read = feed.read_matches_json(spark, path).agg(
        F.count("*").alias("matches"), F.sum("id").alias("id_sum"))
    bad = feed.unreadable_responses(spark, path).agg(F.count("*"))
    return read.withColumn("unreadable", bad.scalar())


@query
def compact_store(spark, sf_dir):
    """Three loads, compacted to one batch, then a load of matches that are stored."""
    store = MatchStore(spark, scratch_path(spark, "store"))
    matches = materialize(_transformed(spark, sf_dir), "matches")
    for part in range(3):
        store.load(matches.filter(F.col("match_id") % 3 == part))
    store.compact()
    store.load(_one_goal_more(matches))
    return store.tables().matches.drop("competition_id")


@query
def union_leagues(spark, sf_dir):
    """Five leagues asked for, four landed."""
    read = feed.union_leagues(spark, _land(spark, sf_dir, by_league=True), CODES)
    return read.groupBy(F.col("competition.code").alias("code")).agg(
        F.count("*").alias("matches"), F.sum("id").alias("id_sum")
    )


@query
def league_scope(spark, sf_dir):
    scoped = feed.league_scope(fixture.raw_matches(spark, sf_dir), "EU")
    return scoped.select("id", F.col("competition.code").alias("code"), "status")


@query
def season_scope(spark, sf_dir):
    scoped = feed.season_scope(fixture.raw_matches(spark, sf_dir), 1998)
    return scoped.select("id", F.col("season.startDate").alias("season_start"))


@query
def load_tables(spark, sf_dir):
    """Loaded twice, the second time with other scores: nothing changes."""
    store = MatchStore(spark, scratch_path(spark, "store"))
    matches = _transformed(spark, sf_dir)
    store.load(matches)
    store.load(_one_goal_more(matches))
    return store.tables().matches


@query
def load_metrics(spark, sf_dir):
    store = MatchStore(spark, scratch_path(spark, "store"))
    store.load(_transformed(spark, sf_dir))
    return store.tables().match_metrics


@query
def load_atomicity(spark, sf_dir):
    """A load that fails before its commit leaves the stored tables as they were."""
    class FailsAtCommit(MatchStore):
        def _commit(self, *_):
            raise OSError("lost the storage")

    path = scratch_path(spark, "store")
    matches = _transformed(spark, sf_dir)
    MatchStore(spark, path).load(matches.filter(F.col("match_id") % 2 == 0))
    try:
        FailsAtCommit(spark, path).load(matches)
    except OSError:
        pass
    return MatchStore(spark, path).tables().matches.select("id", "competition_id")


@query
def interleaved_loads(spark, sf_dir):
    """One load per league, all in one space of ids, then every match again with another
    score and a tenth that no league had: only that tenth is new."""
    store = MatchStore(spark, scratch_path(spark, "store"))
    matches = materialize(_transformed(spark, sf_dir), "matches")
    for code in CODES:
        store.load(matches.filter((F.col("competition_code") == code) & (F.col("match_id") % 10 != 7)))
    store.load(_one_goal_more(matches))
    return store.tables().matches.select("id", "home_score_ft")


@query
def concurrent_loads(spark, sf_dir):
    """Two loads that overlap in time: the second commits while the first is under way, has a
    third of its matches, and brings a league of its own."""
    path = scratch_path(spark, "store")
    matches = materialize(_transformed(spark, sf_dir), "matches")
    mine = matches.filter(F.col("competition_code") != "MI")
    theirs = _one_goal_more(matches).filter(
        (F.col("match_id") % 3 == 0) & F.col("competition_code").isin("MI", "AF"))

    class Slow(MatchStore):
        def _stage(self, *args):
            batch = super()._stage(*args)
            if self.version() == 0:
                MatchStore(spark, path).load(theirs, load_id="theirs")
            return batch

    Slow(spark, path).load(mine, load_id="mine")
    tables = MatchStore(spark, path).tables()
    return tables.in_league(tables.matches).select(
        "id", "competition_code", F.col("competition_id").alias("number"), "home_score_ft")


@query
def stream_unreadable(spark, sf_dir):
    """Every tenth response is cut short: a stream loads the others and files the bad ones."""
    raw = fixture.raw_matches(spark, sf_dir)
    text = F.to_json(F.struct(F.array(F.struct(*raw.columns)).alias("matches")))
    cut = F.when(F.col("id") % 10 == 3, F.substring(text, 1, 40)).otherwise(text)
    landing = scratch_path(spark, "landed")
    raw.select(cut.alias("value")).write.text(landing)
    store = MatchStore(spark, scratch_path(spark, "store"))
    stream = ingest.ingest_landed(spark, landing, store, scratch_path(spark, "checkpoint"))
    stream.awaitTermination()
    bad = ingest.unreadable_landed(spark, ingest.unreadable_path(store))
    return store.tables().matches.agg(F.count("*").alias("matches"), F.sum("id").alias("id_sum")).withColumn(
        "unreadable", bad.agg(F.count("*")).scalar())


@query
def league_feed(spark, sf_dir):
    """One league's run over files that lie under ``league=<code>``."""
    read = feed.read_matches_json(spark, _land(spark, sf_dir, by_league=True), league="EU")
    return read.select("id", F.col("competition.code").alias("code"), "status")


def _snapshots(spark: SparkSession, sf_dir: str) -> str:
    """Two days of league AF (the older one incomplete), one day of all others."""
    base = scratch_path(spark, "snapshots")
    matches = materialize(_transformed(spark, sf_dir), "snapshot-input")
    half = matches.filter((F.col("competition_code") == "AF") & (F.col("match_id") % 2 == 0))
    snapshots.write_league_snapshot(base, half, date(2026, 8, 13), "AF")
    for code in CODES:
        league = matches.filter(F.col("competition_code") == code)
        day = date(2026, 8, 14 if code == "AF" else 13)
        snapshots.write_league_snapshot(base, league, day, code)
    return base


@query
def write_league_snapshot(spark, sf_dir):
    base = _snapshots(spark, sf_dir)
    return spark.read.parquet(f"{base}/matches").groupBy("league", "snapshot_date").agg(
        F.count("*").alias("matches"),
        F.sum("id").alias("id_sum"),
        F.max("competition_id").alias("top_competition_id"),
    )


@query
def write_league_snapshot_rerun(spark, sf_dir):
    """A rerun of the same day fails half-way: the first run's snapshot stays. Another one
    succeeds with half of the matches, and takes its place."""
    base = scratch_path(spark, "snapshots")
    matches = materialize(_transformed(spark, sf_dir), "snapshot-input")
    day = date(2026, 8, 13)
    for code in ("AF", "EU"):
        snapshots.write_league_snapshot(base, matches.filter(F.col("competition_code") == code), day, code)
    half = matches.filter("competition_code = 'AF' AND match_id % 2 = 0")
    extract = snapshots.extract_teams
    try:
        snapshots.extract_teams = _fails
        snapshots.write_league_snapshot(base, half.limit(1), day, "AF")
    except OSError:
        pass
    finally:
        snapshots.extract_teams = extract
    first = snapshots.read_merged(spark, base, CODES, CODES).matches.select("id", F.lit("first").alias("run"))
    snapshots.write_league_snapshot(base, half, day, "AF")
    second = snapshots.read_merged(spark, base, CODES, CODES).matches.select("id", F.lit("second").alias("run"))
    return first.unionByName(second)


def _fails(rows):
    raise OSError("lost the storage")


@query
def union_leagues_shared_ids(spark, sf_dir):
    """A third of the matches of league AF also lie under EU, one goal more: the league
    that is named first has the first copy, in either order."""
    raw = fixture.raw_matches(spark, sf_dir)
    path = scratch_path(spark, "landed")
    copy = raw.filter("competition.code = 'AF' AND id % 3 = 0").withColumn("score", F.col("score").withField(
        "fullTime.home", (F.col("score.fullTime.home").cast("bigint") + 1).cast("string")))
    for rows, code in ((raw.filter("competition.code = 'AF'"), "AF"),
                       (raw.filter("competition.code = 'EU'").unionByName(copy), "EU")):
        rows.select(F.array(F.struct(*raw.columns)).alias("matches")).write.json(f"{path}/league={code}")

    def kept(codes):
        read = transform.transform_matches(feed.union_leagues(spark, path, codes))
        return read.select("match_id", "home_score_ft", F.lit(codes[0]).alias("first"))

    return kept(["AF", "ZZ", "EU"]).unionByName(kept(["EU", "AF"]))


@query
def read_league_snapshots(spark, sf_dir):
    """Four of five leagues asked for, and one without a snapshot."""
    base = _snapshots(spark, sf_dir)
    parts = snapshots.read_league_snapshots(spark, base, ["AF", "AM", "AS", "EU", "ZZ"], CODES)
    return parts["matches"].select("league", "id", "home_score_ft", "away_score_ft")


@query
def skip_empty_run(spark, sf_dir):
    store = MatchStore(spark, scratch_path(spark, "store"))
    result = run(_raw(spark, sf_dir), store, league="ZZ")
    return store.tables().matches.agg(F.count("*").alias("stored")).select(
        "stored",
        F.lit(result.matches).cast("bigint").alias("matches"),
        F.lit(result.inserted).cast("bigint").alias("inserted"),
    )


@query
def sql_read(spark, sf_dir):
    return fixture.tables(spark, sf_dir).query(
        """
        SELECT c.code, t.name AS team, COUNT(*) AS home_games
        FROM matches m
        JOIN competitions c ON c.id = m.competition_id
        JOIN teams t ON t.id = m.home_team_id
        WHERE (:code IS NULL OR c.code = :code)
        GROUP BY c.code, t.name
        ORDER BY home_games DESC, team
        LIMIT :n
        """,
        code="AS",
        n=7,
    )


# Clean and derive ----------------------------------------------------------


@query
def normalize_matches(spark, sf_dir):
    return _flat(spark, sf_dir).drop("ordinal")


@query
def completed_filter(spark, sf_dir):
    return transform.completed_only(_flat(spark, sf_dir)).select("match_id", "status")


@query
def drop_incomplete(spark, sf_dir):
    mid = F.col("match_id")
    holes = _flat(spark, sf_dir).withColumns(
        {
            "home_score_ft": F.when(mid % 13 != 0, F.col("home_score_ft")),
            "away_score_ft": F.when(mid % 19 != 0, F.col("away_score_ft")),
            "utc_date": parse_utc(F.when(mid % 17 == 0, "bad").otherwise(F.col("utc_date"))),
        }
    )
    return transform.drop_incomplete(holes).select("match_id", "home_score_ft", "away_score_ft")


@query
def coerce_scores(spark, sf_dir):
    mid = F.col("match_id")
    dirty = _flat(spark, sf_dir).withColumns(
        {
            "home_score_ft": F.when(mid % 7 == 0, "x").otherwise(F.col("home_score_ft")),
            "away_score_ft": F.when(mid % 11 == 0, F.concat("away_score_ft", F.lit(".7")))
            .otherwise(F.col("away_score_ft")),
        }
    )
    return transform.coerce_scores(dirty).select(
        "match_id", "home_score_ft", "away_score_ft", "home_score_ht", "away_score_ht"
    )


@query
def dedupe_matches(spark, sf_dir):
    """Every match twice, the second time with another score: the first stays."""
    first = transform.coerce_scores(
        transform.normalize_matches(
            fixture.with_ordinal(
                fixture.raw_matches(spark, sf_dir).withColumn("copy", F.lit(0)), line="copy"
            )
        )
    )
    second = _one_goal_more(first).withColumn(
        "ordinal", F.col("ordinal").withField("line", F.lit(1).cast("bigint"))
    )
    kept = transform.dedupe_matches(second.unionByName(first))
    return kept.select("match_id", "home_score_ft", "away_score_ft")


@query
def parse_utc_date(spark, sf_dir):
    """Every third match in another zone, every fifth unreadable."""
    mid = F.col("match_id")
    text = (
        F.when(mid % 5 == 0, "bad")
        .when(mid % 3 == 0, F.regexp_replace("utc_date", "Z$", "-03:00"))
        .otherwise(F.col("utc_date"))
    )
    parsed = _flat(spark, sf_dir).select("match_id", parse_utc(text).alias("instant"))
    return parsed.select(
        "match_id",
        F.unix_seconds("instant").alias("seconds"),
        utc_day(F.col("instant")).alias("day"),
    )


@query
def transform_matches(spark, sf_dir):
    return _transformed(spark, sf_dir).drop("ordinal", "utc_date")


@query
def match_date(spark, sf_dir):
    return _transformed(spark, sf_dir).select("match_id", "match_date")


for _metric in METRICS:
    over_tables(_metric, lambda t, name=_metric: t.match_metrics.select("match_id", name))


over_tables("month_name", lambda t: t.facts.select(
    "match_id", month_name(F.col("match_month")).alias("month_name")))


def _with_away_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transformed(spark, sf_dir).withColumn(
        "away_team_name", F.concat("away_team_name", F.lit(" (away)"))
    )


@query
def extract_teams(spark, sf_dir):
    return transform.extract_teams(_with_away_suffix(spark, sf_dir))


@query
def extract_competitions(spark, sf_dir):
    """A league's later matches carry another name: the first one stays."""
    first = F.col("match_id") < 1000
    renamed = _transformed(spark, sf_dir).withColumn(
        "competition_name",
        F.when(first, F.col("competition_name")).otherwise(F.concat("competition_name", F.lit("!"))),
    )
    return transform.extract_competitions(renamed)


@query
def run_summary(spark, sf_dir):
    matches = _transformed(spark, sf_dir)
    return transform.run_summary(matches, transform.extract_teams(matches))


# Idempotent load -----------------------------------------------------------


@query
def upsert_competitions(spark, sf_dir):
    """Two leagues are stored under old names and ids 3 and 7."""
    found = fixture.competitions(spark, sf_dir)
    stored = found.filter(F.col("code").isin("AF", "EU")).select(
        F.when(F.col("code") == "AF", 3).otherwise(7).cast("bigint").alias("id"),
        "code",
        F.concat("name", F.lit(" (old)")).alias("name"),
    )
    return stored.unionByName(load.new_competitions(stored, found))


@query
def upsert_teams(spark, sf_dir):
    found = fixture.teams(spark, sf_dir).toDF("team_id", "team_name")
    stored = found.filter(F.col("team_id") % 2 == 0).select(
        F.col("team_id").alias("id"), F.concat("team_name", F.lit(" (old)")).alias("name")
    )
    return stored.unionByName(load.new_teams(stored, found))


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = fixture.competitions(spark, sf_dir).select(
        F.col("id").alias("competition_id"), F.col("code").alias("competition_code")
    )
    played = fixture.played_matches(spark, sf_dir).withColumnRenamed("id", "match_id")
    return played.join(codes, "competition_id").drop("competition_id")


@query
def insert_new_matches(spark, sf_dir):
    """Even ids are stored with one goal more; they must keep it."""
    stored = _one_goal_more(
        fixture.played_matches(spark, sf_dir).filter(F.col("id") % 2 == 0)
    ).select(*MATCHES.names)
    leagues = fixture.competitions(spark, sf_dir)
    fresh = load.new_matches(stored, leagues, _fresh(spark, sf_dir)).select(*MATCHES.names)
    return stored.unionByName(fresh).select("id", "competition_id", "home_score_ft")


@query
def insert_new_metrics(spark, sf_dir):
    """Metrics of even ids are stored; matches divisible by three are not."""
    fresh = _fresh(spark, sf_dir)
    stored = fresh.filter(F.col("match_id") % 2 == 0).select(
        "match_id", *[F.lit(9).cast("bigint").alias(name) for name in METRICS]
    )
    parents = fresh.filter(F.col("match_id") % 3 != 0).select(F.col("match_id").alias("id"))
    return stored.unionByName(load.new_metrics(stored, parents, fresh)).select(
        "match_id", "total_goals", "home_win"
    )


@query
def key_checks(spark, sf_dir):
    mid = F.col("match_id")
    holes = _transformed(spark, sf_dir).withColumns(
        {
            "match_id": F.when(mid % 101 != 0, mid),
            "home_team_id": F.when(mid % 7 != 0, F.col("home_team_id")),
            "competition_code": F.when(mid % 11 != 0, F.col("competition_code")),
        }
    )
    return load.key_checks(holes)


@query
def orphan_checks(spark, sf_dir):
    t = fixture.tables(spark, sf_dir)
    known = t.teams.filter(F.col("id") % 7 != 0)
    kept = t.matches.filter(F.col("id") % 5 != 0)
    leagues = t.competitions.filter(F.col("code") != "AS")
    return load.orphan_checks(MatchTables(leagues, known, kept, t.match_metrics))


# Snapshot merge ------------------------------------------------------------


def _two_snapshots(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """PL and PD hold the same matches; PD numbers its leagues otherwise and
    has one goal more per match and new names."""
    t = fixture.tables(spark, sf_dir)

    def ranked(first: DataFrame, second: DataFrame) -> DataFrame:
        both = first.withColumn("league", F.lit("PL")).unionByName(
            second.withColumn("league", F.lit("PD"))
        )
        return merge.rank_leagues(both)

    turned = (F.col("id") + 2) % 5
    renumbered = ((F.col("competition_id") + 2) % 5).cast("bigint")
    goals_more = t.match_metrics.withColumn("total_goals", F.col("total_goals") + 1)
    return {
        "competitions": ranked(t.competitions, t.competitions.withColumn("id", turned)),
        "teams": ranked(
            t.teams, t.teams.withColumn("name", F.concat("name", F.lit(" (new)")))
            .filter(F.col("id") % 3 == 0)
        ),
        "matches": ranked(
            t.matches, _one_goal_more(t.matches).withColumn("competition_id", renumbered)
            .filter(F.col("id") % 4 != 0)
        ),
        "metrics": ranked(t.match_metrics, goals_more.filter(F.col("match_id") % 4 != 0)),
    }


@query
def merge_competitions(spark, sf_dir):
    return merge.merge_competitions(_two_snapshots(spark, sf_dir)["competitions"])


@query
def merge_teams(spark, sf_dir):
    return merge.merge_teams(_two_snapshots(spark, sf_dir)["teams"])


@query
def merge_matches(spark, sf_dir):
    parts = _two_snapshots(spark, sf_dir)
    return merge.merge_matches(parts["matches"], parts["competitions"])


@query
def merge_metrics(spark, sf_dir):
    return merge.merge_metrics(_two_snapshots(spark, sf_dir)["metrics"]).select(
        "match_id", "total_goals", "home_win"
    )


@query
def merge_league_snapshots(spark, sf_dir):
    """Five leagues from storage, merged; only the latest day of each counts."""
    base = _snapshots(spark, sf_dir)
    merged = snapshots.read_merged(spark, base, CODES, CODES)
    return merged.in_league(merged.facts).groupBy(
        "competition_id", "competition_code", "competition"
    ).agg(
        F.count("*").alias("matches"),
        F.sum("match_id").alias("id_sum"),
        F.sum("total_goals").alias("goals"),
    )


@query
def refreshed_snapshots(spark, sf_dir):
    """Five leagues merged, then one has a newer snapshot that takes matches from another."""
    base, target = _snapshots(spark, sf_dir), scratch_path(spark, "merged")
    merged_store.refresh_merged(spark, base, target, CODES, CODES)
    taken = _one_goal_more(_transformed(spark, sf_dir)).filter(
        "competition_code = 'EU' OR (competition_code = 'AS' AND match_id % 4 = 0)")
    snapshots.write_league_snapshot(base, taken, date(2026, 8, 20), "EU")
    merged = merged_store.refresh_merged(spark, base, target, CODES, CODES)
    return merged.in_league(merged.matches).select("id", "competition_id", "competition_code", "home_score_ft")


# The core primitive --------------------------------------------------------

over_tables("appearances", lambda t: appearances(t).drop("competition"))


@query
def appearances_without_metrics(spark, sf_dir):
    """Every third match has no metrics; all of them are seen from both sides."""
    played = fixture.played_matches(spark, sf_dir)
    measured = F.col("id") % 3 != 0
    wide = played.withColumns({name: F.when(measured, F.col(name)) for name in METRICS})
    return goal_lines(MatchTables.from_wide(
        fixture.competitions(spark, sf_dir), fixture.teams(spark, sf_dir), wide))



# Reports -------------------------------------------------------------------

over_tables("competitions", outcomes.competitions)
over_tables("summary", outcomes.summary)
over_tables("summary_league", lambda t: outcomes.summary(t, "AF"))
over_tables("standings", outcomes.standings)
over_tables("standings_league", lambda t: outcomes.standings(t, "EU"))
over_tables("standings_through_matchday", lambda t: outcomes.standings(t, None, 12))
over_tables("matchday_bounds", outcomes.matchday_bounds)
over_tables("matchday_bounds_none", lambda t: outcomes.matchday_bounds(t, "ZZ"))
over_tables("team_form", outcomes.team_form)
over_tables("team_form_3", lambda t: outcomes.team_form(t, "AM", 3))
over_tables("home_away_splits", outcomes.home_away_splits)
over_tables("top_scoring_teams", goals.top_scoring_teams)
over_tables("top_scoring_teams_league", lambda t: goals.top_scoring_teams(t, "AS", 5))
over_tables("goals_by_month", goals.goals_by_month)
over_tables("high_scoring_matches", goals.high_scoring_matches)
over_tables("clean_sheet_leaders", goals.clean_sheet_leaders)
over_tables("schedule_density", sequences.schedule_density)
over_tables("schedule_density_league", lambda t: sequences.schedule_density(t, "MI"))
over_tables("bounce_back", sequences.bounce_back)
over_tables("bounce_back_league", lambda t: sequences.bounce_back(t, "AF", 1000))
over_tables("competitive_balance", sequences.competitive_balance)
over_tables("efficiency_matrix", goals.efficiency_matrix)
over_tables("defensive_solidity", sequences.defensive_solidity)
over_tables("defensive_solidity_league", lambda t: sequences.defensive_solidity(t, "EU", 1000))


@query
def home_away_splits_missing_metrics(spark, sf_dir):
    """Separate tables, some matches without metrics: those do not count."""
    t = fixture.tables(spark, sf_dir)
    measured = t.match_metrics.filter(F.col("match_id") % 101 != 0)
    return outcomes.home_away_splits(
        MatchTables(t.competitions, t.teams, t.matches, measured)
    )


# Averages leave unknown values out, as SQL's AVG does.
for _name, _build in {
    "summary": outcomes.summary, "standings": outcomes.standings,
    "home_away_splits": outcomes.home_away_splits, "goals_by_month": goals.goals_by_month,
    "sql_goals_by_month": documented.sql_goals_by_month, "outcome_rates": documented.outcome_rates,
    "schedule_density": sequences.schedule_density, "efficiency_matrix": goals.efficiency_matrix,
    "defensive_solidity": lambda t: sequences.defensive_solidity(t, None, 1000),
    "top_scoring_teams": goals.top_scoring_teams,
}.items():
    QUERIES[f"{_name}_unknown_scores"] = lambda spark, sf_dir, build=_build: build(
        fixture.unknown_scores(spark, sf_dir))


# Pieces of the reports -----------------------------------------------------


over_tables("recent_matches", lambda t: outcomes.recent_matches(t, window=4).select(
    "team_id", "match_id", "recency"))
over_tables("rest_days", lambda t: slices.rest_days(appearances(t)).select(
    "team_id", "match_id", "rest_days"))
over_tables("rest_band", lambda t: slices.rest_days(appearances(t)).select(
    "team_id", "match_id", sequences.rest_band(F.col("rest_days")).alias("rest_band")))
over_tables("preceded_by_loss", lambda t: slices.preceded_by_loss(appearances(t)).select(
    "team_id", "match_id", "preceded_by_loss"))
over_tables("baseline_ppg", sequences.baseline_ppg)
over_tables("running_points", lambda t: slices.running_points(appearances(t)).select(
    "competition_code", "team_id", "match_id", "matchweek", "cumulative_points"))
over_tables("attack_tier", sequences.attack_tier)
over_tables("opponent_grade", lambda t: sequences.opponent_grade(t).select(
    "competition_code", "match_id", "team_id", "opponent_id",
    F.col("ga").alias("conceded"), "opponent_tier"))
over_tables("venue_average", lambda t: goals.venue_averages(goal_lines(t)))

# Stand-alone reports -------------------------------------------------------

over_tables("sql_standings", documented.sql_standings)
over_tables("sql_top_scoring", documented.sql_top_scoring)
over_tables("sql_high_scoring", documented.sql_high_scoring)
over_tables("sql_clean_sheets", documented.sql_clean_sheets)
over_tables("outcome_rates", documented.outcome_rates)
over_tables("sql_goals_by_month", documented.sql_goals_by_month)
over_tables("comeback_wins", documented.comeback_wins)
over_tables("team_performance_summary", documented.team_performance_summary)

# Shaping -------------------------------------------------------------------

over_tables("standings_top_n", lambda t: shape.standings_top_n(outcomes.standings(t), 3))
over_tables("form_top", lambda t: shape.form_top(outcomes.team_form(t)))
over_tables("rest_band_pivot", lambda t: shape.rest_band_pivot(sequences.schedule_density(t)))
over_tables("parity_pivot", lambda t: shape.parity_pivot(sequences.competitive_balance(t), NAMES))
over_tables("parity_pivot_all", lambda t: shape.parity_pivot(
    sequences.competitive_balance(t), outcomes.competitions(t)))
over_tables("splits_chart", lambda t: shape.splits_chart(outcomes.home_away_splits(t)))
over_tables("kpi_format", lambda t: shape.kpi_format(outcomes.summary(t)))
over_tables("standings_view", lambda t: shape.standings_view(outcomes.standings(t)))
over_tables("form_view", lambda t: shape.form_view(outcomes.team_form(t)))
over_tables("bounce_back_view", lambda t: shape.bounce_back_view(sequences.bounce_back(t)))
over_tables("solidity_view", lambda t: shape.solidity_view(sequences.defensive_solidity(t)))
over_tables("league_code_for_name", lambda t: shape.league_code_for_name(t, "MIDDLE EAST"))
over_tables("report", lambda t: dispatch.report(t, "parity", "EU"))
for _name in ("summary", "standings", "efficiency", "form", "splits", "fatigue", "resilience",
              "parity", "defense"):
    over_tables(f"report_{_name}", lambda t, name=_name: dispatch.report(t, name))
over_tables("round_robin_fixtures", shape.schedule_completeness)


@query
def cached_reports(spark, sf_dir):
    reports = dispatch.CachedReports(lambda: fixture.tables(spark, sf_dir))
    first = reports.report("efficiency")
    first.count()
    kept = reports.report("efficiency")
    if kept is not first or not kept.storageLevel.useMemory:
        raise AssertionError("The second request did not get the kept result.")
    return kept


@query
def stored_reports(spark, sf_dir):
    """Asked before and after a load: the first answer is of half of the matches."""
    store = MatchStore(spark, scratch_path(spark, "store"))
    matches = materialize(_transformed(spark, sf_dir), "matches")
    reports = dispatch.StoredReports(store, scratch_path(spark, "reports"))

    def answer(when):
        return reports.report("efficiency").withColumn("asked", F.lit(when))

    store.load(matches.filter("match_id % 2 = 0"))
    before = answer("before")
    store.load(matches)
    return before.unionByName(answer("after"))


@query
def console_report(spark, sf_dir):
    """Rows of each section of the text report, the names in its first text column
    and the sum of a number it shows."""
    parts = console.sections(fixture.tables(spark, sf_dir))
    shown = (("competition", "Pts"), ("team", "points"), ("competition", "matches"),
             ("team", "total_goals"), ("month_name", "total_goals"))
    counted = [
        rows.agg(
            F.count("*").alias("rows"),
            F.array_join(F.sort_array(F.collect_set(name)), ",").alias("names"),
            F.sum(number).cast("bigint").alias("total"),
        ).select(F.lit(title).alias("section"), "rows", "names", "total")
        for (title, rows), (name, number) in zip(parts.items(), shown)
    ]
    union = counted[0]
    for part in counted[1:]:
        union = union.unionByName(part)
    return union
