"""What the plans must look like to hold at scale."""

import re

import pytest

from checks import fixture
from checks.queries import QUERIES
from tests.conftest import raw_match
from touchline.operators import transform
from touchline.plans import goals, outcomes, sequences
from touchline.tables import MatchTables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The fixture as written tables, as a store would hold them."""
    base = str(tmp_path_factory.mktemp("tables"))
    built = fixture.tables(spark, SF)
    for name in ("competitions", "teams", "wide"):
        getattr(built, name).write.parquet(f"{base}/{name}")
    read = {name: spark.read.parquet(f"{base}/{name}") for name in ("competitions", "teams", "wide")}
    return MatchTables.from_wide(**read)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def scans(text, column):
    """Read schemas of the scans that read a column."""
    return [found for found in re.findall(r"ReadSchema: struct<([^>]*)>", text) if column in found]


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in (
    # These write their input first; their reports are covered by the others.
    "read_matches_json", "union_leagues", "load_tables", "load_metrics", "load_atomicity",
    "write_league_snapshot", "read_league_snapshots", "skip_empty_run", "merge_league_snapshots",
    "cached_reports")])
def test_no_pairs_without_a_key(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text and "InPandas" not in text


def test_only_used_columns_are_read(stored):
    read = scans(plan(outcomes.home_away_splits(stored, "EU")), "home_win")
    assert read and all(
        set(re.findall(r"(\w+):", found))
        == {"competition_id", "total_goals", "home_win", "away_win", "is_draw"}
        for found in read
    )


def test_matchday_filter_reaches_the_scan(stored):
    assert "LessThanOrEqual(matchday,12)" in plan(outcomes.standings(stored, None, 12))


def test_latest_games_are_cut_before_the_shuffle(stored):
    text = plan(outcomes.team_form(stored))
    assert len(re.findall(r"WindowGroupLimit \[team_id.*Partial", text)) == 1
    assert len(re.findall(r"WindowGroupLimit \[team#.*Partial", text)) == 1


def test_copies_are_cut_before_the_shuffle(landed):
    raw = landed(raw_match(1))
    assert re.search(r"WindowGroupLimit \[match_id.*Partial", plan(transform.transform_matches(raw)))
    teams = transform.extract_teams(transform.normalize_matches(raw))
    assert re.search(r"WindowGroupLimit \[team_id.*Partial", plan(teams))


def test_top_matches_do_not_sort_everything(stored):
    assert "TakeOrderedAndProject" in plan(goals.high_scoring_matches(stored))


@pytest.mark.parametrize("build, most", [
    (sequences.schedule_density, 1), (sequences.bounce_back, 1),
    (sequences.competitive_balance, 1)])
def test_ordered_reports_read_the_games_once(stored, build, most):
    frame = build(stored)
    frame.collect()
    final = plan(frame).split("== Initial Plan ==")[0]
    assert 1 <= len(scans(final, "match_date")) <= most


@pytest.mark.parametrize("build", [sequences.bounce_back, sequences.competitive_balance])
def test_ordered_reports_split_teams_by_slice(stored, build):
    for ordered in re.findall(r"windowspecdefinition\((.*?) ASC", plan(build(stored))):
        if "match_id" in ordered and "team_id" in ordered:
            assert "day" in ordered and "block" in ordered


@pytest.mark.parametrize("build", [outcomes.standings, sequences.attack_tier,
                                   sequences.defensive_solidity])
def test_games_are_folded_once(stored, build):
    """Ranking reads its table several times; the games behind it are read once."""
    frame = build(stored)
    frame.collect()
    final = plan(frame).split("== Initial Plan ==")[0]
    assert len(scans(final, "home_score_ft")) == 1


def test_orphans_read_each_table_once(stored):
    from touchline.operators.load import orphan_checks

    frame = orphan_checks(stored)
    frame.collect()
    final = plan(frame).split("== Initial Plan ==")[0]
    assert len(scans(final, "home_team_id")) == 1
    assert "Join" not in final


def test_one_league_opens_its_own_files(spark, tmp_path):
    from touchline.sources import feed

    for code in ("PL", "SA"):
        (tmp_path / f"league={code}").mkdir()
        (tmp_path / f"league={code}" / "a.json").write_text('{"matches": [{"id": 1}]}\n')
    read = feed.read_matches_json(spark, str(tmp_path), league="SA")
    assert [r["id"] for r in read.collect()] == [1]
    text = plan(read)
    assert "PartitionFilters: [isnotnull(league" in text and "(league" in text and "= SA)" in text
    (tmp_path / "league=PL" / "a.json").unlink()  # listed, but never opened
    assert read.count() == 1
