import json

import pytest

from tests.conftest import raw_match, rows
from touchline.operators.transform import (
    extract_competitions,
    extract_teams,
    normalize_matches,
    transform_matches,
)
from touchline.schema import METRICS
from touchline.sources import feed


def one(frame):
    result = rows(frame)
    assert len(result) == 1
    return result[0]


def test_awarded_matches_count(transformed):
    row = one(transformed(raw_match(1, status="AWARDED", ft=(3, 0), winner="HOME_TEAM")))
    assert row["home_win"] == 1


def test_scheduled_matches_are_dropped(transformed):
    assert transformed(raw_match(1, status="SCHEDULED", ft=(None, None), winner=None)).isEmpty()


def test_empty_input_stays_empty(transformed):
    frame = transformed()
    assert frame.isEmpty()
    assert set(METRICS) <= set(frame.columns)


def test_all_metrics_of_a_comeback(transformed):
    row = one(transformed(raw_match(1, ft=(3, 2), ht=(0, 2), date="2025-09-06T15:00:00Z")))
    assert {name: row[name] for name in METRICS} == {
        "total_goals": 5, "goal_differential": 1, "home_win": 1, "away_win": 0, "is_draw": 0,
        "both_teams_scored": 1, "clean_sheet_home": 0, "clean_sheet_away": 0, "high_scoring": 1,
        "halftime_home_lead": 0, "halftime_away_lead": 1, "comeback_home": 1,
        "comeback_away": 0, "second_half_goals": 3, "match_month": 9, "match_weekday": 5,
    }


def test_threshold_is_a_parameter(landed):
    raw = landed(raw_match(1, ft=(2, 1)))
    assert one(transform_matches(raw, threshold=3))["high_scoring"] == 1
    assert one(transform_matches(raw))["high_scoring"] == 0


@pytest.mark.parametrize("date", ["bad", "", None, "2025-13-40T00:00:00Z"])
def test_unreadable_dates_are_dropped(transformed, date):
    assert transformed(raw_match(1, date=date)).isEmpty()


@pytest.mark.parametrize(
    "date, day",
    [
        ("2025-09-01T22:30:00-03:00", "2025-09-02"),
        ("2025-09-01T22:30:00Z", "2025-09-01"),
        ("2025-09-01T22:30:00", "2025-09-01"),
        ("2025-09-01", "2025-09-01"),
        ("2025-09-01T01:30:00+0200", "2025-08-31"),
    ],
)
def test_dates_are_utc_days(spark, transformed, date, day):
    frame = transformed(raw_match(1, date=date))
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert str(one(frame)["match_date"]) == day
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "score, expected", [("x", 0), (2.7, 2), ("2.7", 2), ("NaN", 0), (" 3 ", 3), ("1e400", 0)]
)
def test_bad_scores_become_numbers(transformed, score, expected):
    assert one(transformed(raw_match(1, ft=(score, 1), winner=None)))["home_score_ft"] == expected


def test_null_full_time_score_drops_the_match(transformed):
    assert transformed(raw_match(1, ft=(None, 1), winner="AWAY_TEAM")).isEmpty()


@pytest.mark.parametrize("ht", [None, (None, None)])
def test_missing_half_time_is_nil_nil(transformed, ht):
    row = one(transformed(raw_match(1, ft=(1, 0), ht=ht)))
    assert (row["home_score_ht"], row["away_score_ht"], row["second_half_goals"]) == (0, 0, 1)


def test_second_half_goals_never_negative(transformed):
    assert one(transformed(raw_match(1, ft=(1, 0), ht=(2, 2))))["second_half_goals"] == 0


def test_no_winner_no_outcome(transformed):
    row = one(transformed(raw_match(1, ft=(2, 1), winner=None)))
    assert (row["home_win"], row["away_win"], row["is_draw"]) == (0, 0, 0)


def test_first_copy_of_a_match_stays(transformed):
    frame = transformed(raw_match(1, ft=(1, 0)), raw_match(2), raw_match(1, ft=(4, 4)))
    assert {r["match_id"]: r["home_score_ft"] for r in rows(frame)} == {1: 1, 2: 1}


def test_null_ids_are_one_match(transformed):
    frame = transformed(raw_match(None, ft=(5, 0)), raw_match(None, ft=(6, 0)))
    assert [r["home_score_ft"] for r in rows(frame)] == [5]


def test_first_copy_goes_by_file_then_line_then_place(spark, tmp_path):
    def response(*matches):
        return json.dumps({"matches": list(matches)}) + "\n"

    (tmp_path / "b.json").write_text(response(raw_match(1, ft=(9, 0))))
    (tmp_path / "a.json").write_text(
        response(raw_match(2, ft=(1, 0)), raw_match(2, ft=(2, 0)))
        + response(raw_match(1, ft=(3, 0)), raw_match(2, ft=(4, 0)))
        + response(raw_match(1, ft=(5, 0)))
    )
    frame = transform_matches(feed.read_matches_json(spark, str(tmp_path)))
    assert {r["match_id"]: r["home_score_ft"] for r in rows(frame)} == {1: 3, 2: 1}


def test_referee_is_the_first_or_null(landed):
    raw = landed(raw_match(1, referees=("A", "B")), raw_match(2, referees=()))
    assert {r["match_id"]: r["referee"] for r in rows(normalize_matches(raw))} == {1: "A", 2: None}


def test_home_name_beats_away_name(transformed):
    frame = transformed(
        raw_match(1, home=(1, "One"), away=(2, "Two, away")),
        raw_match(2, home=(2, "Two"), away=(3, "Three, first")),
        raw_match(3, home=(2, "Two again"), away=(3, "Three, later")),
    )
    assert {r["team_id"]: r["team_name"] for r in rows(extract_teams(frame))} == {
        1: "One", 2: "Two", 3: "Three, first",
    }


def test_competitions_are_numbered_by_code(transformed):
    frame = transformed(
        raw_match(1, code="SA", name="Serie A"),
        raw_match(2, code="PL", name="Premier League"),
        raw_match(3, code="SA", name="Renamed"),
    )
    assert sorted((r["id"], r["code"], r["name"]) for r in rows(extract_competitions(frame))) == [
        (1, "PL", "Premier League"), (2, "SA", "Serie A"),
    ]


def test_bad_line_does_not_fail_the_rest(spark, tmp_path):
    path = tmp_path / "feed.json"
    path.write_text("{not json\n" + json.dumps({"matches": [raw_match(1)]}) + "\n")
    assert [r["id"] for r in rows(feed.read_matches_json(spark, str(path)))] == [1]


def test_pretty_printed_response(spark, tmp_path):
    path = tmp_path / "feed.json"
    path.write_text(json.dumps({"matches": [raw_match(1), raw_match(2)]}, indent=2))
    read = feed.read_matches_json(spark, str(path), multi_line=True)
    assert sorted(r["id"] for r in rows(read)) == [1, 2]


def test_missing_league_is_skipped(spark, tmp_path):
    for code, mid in (("PL", 1), ("SA", 2)):
        folder = tmp_path / f"league={code}"
        folder.mkdir()
        (folder / "r.json").write_text(json.dumps({"matches": [raw_match(mid, code=code)]}))
    read = feed.union_leagues(spark, str(tmp_path), ["PL", "PD", "SA"])
    assert sorted(r["id"] for r in rows(read)) == [1, 2]
    assert transform_matches(feed.union_leagues(spark, str(tmp_path), ["PD"])).isEmpty()


def test_season_scope(landed):
    raw = landed(raw_match(1, season="2025-08-17"), raw_match(2, season="2026-08-15"),
                 raw_match(3, season=None))
    assert [r["id"] for r in rows(feed.season_scope(raw, 2025))] == [1]
    assert feed.season_scope(raw, None).count() == 3


def test_league_scope(landed):
    raw = landed(raw_match(1, code="PL"), raw_match(2, code="SA"))
    assert [r["id"] for r in rows(feed.league_scope(raw, "SA"))] == [2]
    assert feed.league_scope(raw, None).count() == 2


def test_unreadable_responses_are_counted(spark, tmp_path):
    good = json.dumps({"matches": [raw_match(1)]})
    (tmp_path / "feed.json").write_text(good + "\n" + good[:40] + "\n")
    path = str(tmp_path / "feed.json")
    assert feed.unreadable_responses(spark, path).count() == 1
    assert feed.read_matches_json(spark, path).count() == 1
    with pytest.raises(ValueError):
        feed.read_matches_json(spark, path, strict=True)


def test_first_league_asked_for_wins(spark, tmp_path):
    for code, goals in (("PL", 1), ("BL1", 2)):
        folder = tmp_path / f"league={code}"
        folder.mkdir()
        (folder / "feed.json").write_text(json.dumps({"matches": [raw_match(1, ft=(goals, 0))]}) + "\n")
    for codes, goals in ((["PL", "BL1"], 1), (["BL1", "PL"], 2)):
        read = transform_matches(feed.union_leagues(spark, str(tmp_path), codes)).collect()
        assert [row["home_score_ft"] for row in read] == [goals]
