"""Reports next to their SQL on the smallest data, days cut into small blocks of ids."""

import pytest

import __spark_entry__ as entry_points
from checks.compare import difference
from checks.oracles import ORACLES
from checks.queries import QUERIES
from touchline.operators import slices

SF = "/root/testdata/sf0.001"

REPORTS = [
    "appearances", "transform_matches", "standings", "standings_through_matchday", "team_form_3",
    "schedule_density", "bounce_back_league", "competitive_balance", "rest_days",
    "preceded_by_loss", "running_points", "attack_tier", "defensive_solidity",
    "efficiency_matrix", "high_scoring_matches", "comeback_wins", "team_performance_summary",
    "insert_new_matches", "merge_matches", "round_robin_fixtures", "parity_pivot", "kpi_format",
]


@pytest.mark.parametrize("name", REPORTS)
def test_report_equals_its_sql(spark, name, monkeypatch):
    monkeypatch.setattr(slices, "BLOCK_BITS", 4)
    assert difference(spark, SF, name) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_is_the_league_table(spark):
    assert entry_points.entry(spark).columns[:4] == [
        "position", "competition", "competition_code", "team"]
