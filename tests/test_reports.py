import pytest

from tests.conftest import raw_match, rows
from touchline.operators.appearances import appearances
from touchline.operators.ranking import rank_within
from touchline.plans import console, documented, goals, outcomes, sequences, shape
from touchline.plans.dispatch import CachedReports, report
from touchline.tables import MatchTables

A, B, C = (1, "A"), (2, "B"), (3, "C")


def day(number):
    return f"2025-09-{number:02}T15:00:00Z"


def facts_tables(spark, matches, teams=None, leagues=(("PL", "Premier League"),)):
    """Tables straight from (id, home, away, day, home goals, away goals[, league])."""
    from touchline.operators.transform import derive_metrics
    from touchline.schema import MATCHES
    import datetime as dt

    data = []
    for mid, home, away, number, hs, aws, *league in matches:
        winner = "HOME_TEAM" if hs > aws else "AWAY_TEAM" if aws > hs else "DRAW"
        date = dt.date(2025, 1, 1) + dt.timedelta(days=number)
        data.append((mid, league[0] if league else 1, home, away, date, number, "FINISHED",
                     hs, aws, 0, 0, winner, None))
    ids = {row[2] for row in data} | {row[3] for row in data}
    names = teams or {i: f"T{i}" for i in ids}
    return MatchTables.from_wide(
        spark.createDataFrame([(i + 1, c, n) for i, (c, n) in enumerate(leagues)],
                              "id long, code string, name string"),
        spark.createDataFrame(list(names.items()), "id long, name string"),
        derive_metrics(spark.createDataFrame(data, MATCHES)),
    )


def round_robin(teams, goals_of):
    return [(100 * h + a, h, a, h + a, goals_of(h, a), goals_of(a, h))
            for h in teams for a in teams if h != a]


def test_match_without_winner(tables):
    t = tables(raw_match(1, A, B, ft=(2, 1), winner=None), raw_match(2, A, B, ft=(1, 1)))
    table = {r["team"]: r for r in rows(outcomes.standings(t))}
    assert {n: (r["played"], r["won"], r["drawn"], r["lost"], r["pts"])
            for n, r in table.items()} == {"A": (2, 0, 1, 0, 1), "B": (2, 0, 1, 0, 1)}
    form = {r["team"]: r for r in rows(outcomes.team_form(t, window=2))}
    assert {n: (r["form"], r["losses"]) for n, r in form.items()} == {"A": ("LD", 0), "B": ("LD", 0)}


def test_ids_that_share_a_name(spark):
    t = facts_tables(spark, [(1, 1, 2, 1, 1, 0), (2, 3, 2, 2, 2, 0), (3, 2, 4, 3, 1, 1)],
                     teams={1: "Same", 3: "Same", 2: "B", 4: "D"})
    table = {r["team"]: (r["played"], r["pts"]) for r in rows(outcomes.standings(t))}
    assert table == {"Same": (2, 6), "B": (3, 1), "D": (1, 1)}
    assert {r["team"] for r in rows(outcomes.team_form(t, window=1))} == {"B", "D"}
    assert {r["team"]: r["form"] for r in rows(outcomes.team_form(t, window=2))} == {
        "Same": "WW", "B": "LD"}
    by_id = [r["team_name"] for r in rows(documented.sql_standings(t))]
    assert sorted(by_id) == ["B", "D", "Same", "Same"]


def test_tied_teams_share_a_position(spark):
    t = facts_tables(spark, [(1, 1, 2, 1, 1, 0), (2, 3, 4, 1, 1, 0), (3, 5, 6, 1, 2, 2)])
    assert [(r["position"], r["team"]) for r in rows(outcomes.standings(t))] == [
        (1, "T1"), (1, "T3"), (3, "T5"), (3, "T6"), (5, "T2"), (5, "T4")]


def test_null_matchday_only_counts_without_a_limit(tables):
    t = tables(raw_match(1, A, B, matchday=None), raw_match(2, A, B, matchday=2),
               raw_match(3, A, B, matchday=3))
    assert rows(outcomes.standings(t))[0]["played"] == 3
    assert rows(outcomes.standings(t, through_matchday=2))[0]["played"] == 1
    assert rows(outcomes.matchday_bounds(t)) == [{"lo": 2, "hi": 3}]


def test_bounds_without_matchdays(tables):
    t = tables(raw_match(1, A, B, matchday=None))
    assert rows(outcomes.matchday_bounds(t)) == [{"lo": 1, "hi": 1}]


def test_empty_reports(tables):
    t = tables(raw_match(1, A, B))
    assert outcomes.summary(t, "XX").isEmpty()
    assert outcomes.standings(t, "XX").isEmpty()
    assert goals.goals_by_month(t, "XX").isEmpty()
    assert rows(outcomes.summary(t))[0]["matches"] == 1


def test_competitions_need_matches(spark):
    t = facts_tables(spark, [(1, 1, 2, 1, 0, 0)], leagues=(("PL", "Premier"), ("SA", "Serie A")))
    assert rows(outcomes.competitions(t)) == [{"code": "PL", "name": "Premier"}]


@pytest.mark.parametrize("rest, band", [(0, "Congested (<4d)"), (3, "Congested (<4d)"),
                                        (4, None), (5, None), (6, "Rested (6+d)")])
def test_rest_bands(spark, rest, band):
    t = facts_tables(spark, [(1, 1, 2, 10, 1, 0), (2, 1, 3, 10 + rest, 1, 0)])
    got = rows(sequences.schedule_density(t))
    assert [(r["rest_band"], r["matches"], r["win_pct"]) for r in got] == (
        [(band, 1, 100.0)] if band else [])


def test_rest_sees_only_the_chosen_league(spark):
    matches = [(1, 1, 2, 10, 1, 0, 1), (2, 1, 2, 12, 1, 0, 2), (3, 1, 2, 20, 1, 0, 1)]
    t = facts_tables(spark, matches, leagues=(("PL", "P"), ("CL", "C")))
    assert {(r["competition"], r["rest_band"]): r["matches"]
            for r in rows(sequences.schedule_density(t))} == {
        ("C", "Congested (<4d)"): 2, ("P", "Rested (6+d)"): 2}
    assert {r["rest_band"]: r["matches"] for r in rows(sequences.schedule_density(t, "PL"))} == {
        "Rested (6+d)": 2}


def test_bounce_back_uses_the_rounded_baseline(spark):
    # Team 1: L W L W L W L → three games after a loss, all won; 9 points in 7.
    results = [(0, 1), (1, 0), (0, 1), (1, 0), (0, 1), (1, 0), (0, 1)]
    t = facts_tables(spark, [(i, 1, 10 + i, 10 * i, *score) for i, score in enumerate(results)])
    assert rows(sequences.bounce_back(t)) == [{
        "competition": "Premier League", "team": "T1", "games_after_loss": 3,
        "bounce_back_ppg": 3.0, "overall_ppg": 1.29, "resilience_delta": 1.71}]


def test_small_league_has_tops_before_bottoms(spark):
    t = facts_tables(spark, round_robin(range(1, 7), lambda me, other: me))
    tiers = {r["opponent_id"]: r["opponent_tier"] for r in rows(sequences.opponent_grade(t))}
    assert tiers == {6: "top", 5: "top", 4: "top", 3: "top", 2: "top", 1: "bottom"}
    solid = {r["team"]: r for r in rows(sequences.defensive_solidity(t))}
    assert solid["T1"]["conceded_vs_bottom"] is None
    assert (solid["T6"]["games_vs_top"], solid["T6"]["conceded_vs_top"]) == (8, 3.5)
    assert solid["T6"]["conceded_vs_bottom"] == 1.0


def test_middle_attacks_are_dropped(spark):
    t = facts_tables(spark, round_robin(range(1, 13), lambda me, other: me))
    tiers = {r["opponent_id"]: r["opponent_tier"] for r in rows(sequences.opponent_grade(t))}
    assert tiers == {**dict.fromkeys(range(8, 13), "top"), **dict.fromkeys(range(1, 6), "bottom")}


def test_scorers_need_five_games_and_no_metrics(spark):
    t = facts_tables(spark, [(i, 1, 2, i, i, 0) for i in range(5)] + [(9, 3, 4, 9, 9, 9)])
    bare = MatchTables(t.competitions, t.teams, t.matches, t.match_metrics.limit(0))
    for source in (t, bare):
        assert rows(goals.top_scoring_teams(source)) == [
            {"team": "T1", "avg_goals": 2.0, "avg_home": 2.0, "avg_away": None,
             "total_goals": 10, "played": 5},
            {"team": "T2", "avg_goals": 0.0, "avg_home": None, "avg_away": 0.0,
             "total_goals": 0, "played": 5}]
    assert outcomes.standings(bare).isEmpty()


def test_clean_sheets_skip_teams_without_any(spark):
    t = facts_tables(spark, [(1, 1, 2, 1, 1, 0), (2, 1, 2, 2, 0, 0), (3, 3, 1, 3, 1, 1)])
    assert rows(goals.clean_sheet_leaders(t)) == [
        {"team": "T1", "clean_sheets": 2}, {"team": "T2", "clean_sheets": 1}]


def test_leading_matches_with_and_without_known_teams(spark):
    matches = [(i, 1, 2 + i % 3, i, i % 7, 0) for i in range(1, 40)]
    known = facts_tables(spark, matches)
    want = sorted(((m[4] + m[5], m[3], m[0]) for m in matches), reverse=True)

    def got(t, limit):
        return [(r["total_goals"], r["date"].timetuple().tm_yday - 1)
                for r in rows(goals.high_scoring_matches(t, limit=limit))]

    assert got(known, 6) == [(g, d) for g, d, _ in want[:6]]
    assert len(got(known, 100)) == 39
    # Without team 4 the leaders do not suffice, and later matches move up.
    lacking = facts_tables(spark, matches, teams={1: "T1", 2: "T2", 3: "T3"})
    left = [w for w in want if 2 + w[2] % 3 != 4]
    assert got(lacking, 6) == [(g, d) for g, d, _ in left[:6]]
    assert len(got(lacking, 100)) == len(left)


def test_unknown_competition_counts_only_where_no_league_is_read(spark):
    t = facts_tables(spark, [(1, 1, 2, 1, 1, 0, 1), (2, 1, 2, 2, 1, 0, 99)])
    assert rows(outcomes.summary(t))[0]["matches"] == 1
    assert rows(documented.outcome_rates(t))[0]["total_matches"] == 2
    assert rows(documented.team_performance_summary(t))[0]["played"] == 2
    assert rows(documented.sql_clean_sheets(t)) == [{"team": "T1", "clean_sheets": 2}]


def test_totals_of_a_season(spark):
    t = facts_tables(spark, round_robin(range(1, 9), lambda me, other: (me * other + me) % 4))
    table = rows(outcomes.standings(t))
    assert sum(r["won"] for r in table) == sum(r["lost"] for r in table)
    assert sum(r["played"] for r in table) == 2 * t.matches.count()
    assert sum(r["gd"] for r in table) == 0
    assert [r["pts"] for r in table] == sorted((r["pts"] for r in table), reverse=True)
    assert appearances(t).count() == 2 * t.matches.count()
    form = rows(outcomes.team_form(t, window=3))
    assert all(r["wins"] + r["draws"] + r["losses"] == 3 for r in form)
    full = rows(shape.schedule_completeness(t))[0]
    assert (full["expected_pairs"], full["missing_pairs"]) == (56, 0)


def test_display_shapes(spark):
    t = facts_tables(spark, round_robin(range(1, 5), lambda me, other: me),
                     leagues=(("PL", "Premier League"),))
    top = rows(shape.standings_top_n(outcomes.standings(t), 2))
    assert [r["team"] for r in top] == ["T4", "T3"]
    assert shape.standings_view(outcomes.standings(t)).columns == [
        "competition", "Pos", "Team", "P", "W", "D", "L", "GF", "GA", "GD", "Pts"]
    assert rows(shape.league_code_for_name(t, "Premier League")) == [{"code": "PL"}]


def test_figures_as_text(spark):
    frame = spark.createDataFrame(
        [(1234567, 2.5, 50.5, 49.5, 0.4)],
        "matches long, avg_goals double, home_win_pct double, away_win_pct double, draw_pct double")
    assert rows(shape.kpi_format(frame)) == [{
        "matches": "1,234,567", "avg_goals": "2.50",
        "home_wins": "50%", "away_wins": "50%", "draws": "0%"}]


def test_named_reports(spark):
    t = facts_tables(spark, round_robin(range(1, 5), lambda me, other: me))
    for name in ("summary", "standings", "efficiency", "form", "splits", "fatigue",
                 "resilience", "parity", "defense"):
        assert report(t, name).columns
    with pytest.raises(ValueError, match="Unknown report: nope"):
        report(t, "nope")


def test_cached_reports_expire(spark):
    t = facts_tables(spark, [(1, 1, 2, 1, 1, 0)])
    now, loads = [0.0], []

    def source():
        loads.append(now[0])
        return t

    cached = CachedReports(source, report_ttl=300, source_ttl=1800, clock=lambda: now[0])
    first = cached.report("summary")
    now[0] = 299
    assert cached.report("summary") is first
    assert cached.report("summary", "PL") is not first
    now[0] = 300
    assert cached.report("summary") is not first
    now[0] = 1800
    cached.report("summary")
    assert loads == [0.0, 1800]
    cached.release()


def test_console_report(spark):
    lines = []
    console.console_report(facts_tables(spark, [(1, 1, 2, 1, 1, 0)]), out=lines.append)
    text = "\n".join(lines)
    assert text.index("LEAGUE STANDINGS") < text.index("HOME vs AWAY") < text.index("BY MONTH")
    assert "RECENT FORM" not in text
    empty = facts_tables(spark, [(1, 1, 2, 1, 1, 0, 9)])
    lines.clear()
    console.console_report(empty, out=lines.append)
    assert lines == [console.NO_DATA]


def test_parameterized_sql(spark):
    t = facts_tables(spark, [(1, 1, 2, 1, 1, 0)])
    sql = "SELECT COUNT(*) AS n FROM matches m JOIN competitions c ON c.id = m.competition_id " \
          "WHERE (:code IS NULL OR c.code = :code)"
    assert [rows(t.query(sql, code=code))[0]["n"] for code in (None, "PL", "SA")] == [1, 1, 0]


def test_negative_scores_stay(tables):
    t = tables(raw_match(1), raw_match(2, home=(3, "Third"), away=(4, "Fourth"), ft=(-1, 2), winner="AWAY_TEAM"))
    assert {row["team"] for row in outcomes.standings(t).collect()} == {"Home", "Away", "Third", "Fourth"}
    assert sum(row["games"] for row in sequences.pairings(t).collect()) == 4


def test_unknown_scores_are_ranked_last(spark):
    table = spark.createDataFrame([("x", 3, 1), ("x", 3, None), ("x", None, 5)], "league string, pts long, gd long")
    ranked = rank_within(table, ["league"], ["pts", "gd"], "place")
    assert {(row["pts"], row["gd"]): row["place"] for row in ranked.collect()} == {(3, 1): 1, (3, None): 2, (None, 5): 3}
