"""Slices and ranking against brute force, with data cut into many slices."""

import datetime as dt
import random
from collections import defaultdict
from fractions import Fraction

import pytest

from tests.conftest import rows
from touchline.operators import slices
from touchline.operators.appearances import appearances
from touchline.operators.ranking import rank_within
from touchline.plans import outcomes, sequences
from touchline.schema import MATCHES
from touchline.tables import MatchTables

HOT_TEAM, HOT_DAY = 1, dt.date(2024, 5, 5)


def make_matches(n=600, teams=12, seed=7):
    """Matches in two leagues; one team in a third of them, one day holds a third."""
    rng = random.Random(seed)
    matches = []
    for mid in rng.sample(range(1, 10 * n), n):
        home, away = rng.sample(range(1, teams + 1), 2)
        if rng.random() < 0.33:
            home, away = HOT_TEAM, rng.randint(2, teams)
        day = HOT_DAY if rng.random() < 0.33 else dt.date(2024, 1, 1) + dt.timedelta(
            days=rng.randint(0, 200))
        hs, aws = rng.randint(0, 3), rng.randint(0, 3)
        winner = "HOME_TEAM" if hs > aws else "AWAY_TEAM" if aws > hs else "DRAW"
        if rng.random() < 0.05:
            winner = None
        matches.append((mid, rng.choice([1, 2]), home, away, day, hs, aws, winner))
    return matches


def wide(spark, matches):
    from touchline.operators.transform import derive_metrics

    frame = spark.createDataFrame(
        [(mid, league, home, away, day, 1, "FINISHED", hs, aws, 0, 0, winner, None)
         for mid, league, home, away, day, hs, aws, winner in matches],
        MATCHES,
    )
    return derive_metrics(frame)


def history(matches):
    """Per team: its games in order, as (day, id, league, points, lost, scored, conceded)."""
    games = defaultdict(list)
    for mid, league, home, away, day, hs, aws, winner in matches:
        for team, me, mine, theirs in ((home, "HOME_TEAM", hs, aws), (away, "AWAY_TEAM", aws, hs)):
            points = 3 if winner == me else 1 if winner == "DRAW" else 0
            lost = int(winner in ("HOME_TEAM", "AWAY_TEAM") and winner != me)
            games[team].append((day, mid, league, points, lost, mine, theirs))
    return {team: sorted(rows) for team, rows in games.items()}


@pytest.fixture(scope="module")
def data():
    return make_matches()


@pytest.fixture(scope="module")
def tables(spark, data):
    leagues = spark.createDataFrame([(1, "L1", "One"), (2, "L2", "Two")], "id long, code string, name string")
    teams = spark.createDataFrame([(i, f"Team {i:02}") for i in range(1, 13)], "id long, name string")
    return MatchTables.from_wide(leagues, teams, wide(spark, data))


@pytest.fixture(params=[0, 3, 9, 22])
def block_bits(request, monkeypatch):
    monkeypatch.setattr(slices, "BLOCK_BITS", request.param)
    return request.param


def test_slices_follow_the_order_and_bound_every_team(tables, block_bits):
    cut = defaultdict(list)
    for r in rows(slices.with_slices(appearances(tables))):
        place = (r["month"], r["day"], r["block"])
        cut[r["team_id"]].append((r["match_date"], r["match_id"], place))
    for games in cut.values():
        places = [place for _, _, place in sorted(games)]
        assert places == sorted(places)
        assert max(map(places.count, set(places))) <= 2 ** block_bits


def test_clustered_ids_stay_in_bounded_slices(spark, monkeypatch):
    """One team plays 4,000 games on one day, with ids in a row and one far away."""
    monkeypatch.setattr(slices, "BLOCK_BITS", 8)
    ids = [*range(1000, 5000), 2**61]
    frame = spark.createDataFrame(
        [(1, 1, "One", mid, HOT_DAY, mid % 2, 3 * (1 - mid % 2)) for mid in ids],
        "team_id long, competition_id long, competition string, match_id long, match_date date, "
        "l int, points long")
    sizes = [r["count"] for r in rows(
        slices.with_slices(frame).groupBy("team_id", "month", "day", "block").count())]
    assert sum(sizes) == len(ids) and max(sizes) <= 256
    result, = rows(slices.after_loss(frame))
    assert (result["after_games"], result["after_points"]) == (2000, 6000)
    last = rows(slices.running_points(frame).filter(f"match_id = {2**61}"))[0]
    assert (last["matchweek"], last["cumulative_points"]) == (4001, 2001 * 3)
    rested = rows(slices.rest_days(frame).filter("rest_days = 0"))
    assert len(rested) == 4000


def test_games_without_a_date_come_first(spark):
    days = [None, None, dt.date(2024, 1, 1), dt.date(2024, 1, 8)]
    frame = spark.createDataFrame(
        [(1, 1, "One", 10 - n, day, 1, 0) for n, day in enumerate(days)],
        "team_id long, competition_id long, competition string, match_id long, match_date date, "
        "l int, points long")
    got = {r["match_id"]: r["rest_days"] for r in rows(slices.rest_days(frame))}
    assert got == {10: None, 9: None, 8: None, 7: 7}
    totals = rows(slices.rest_totals(frame, sequences.rest_band, "band", "points"))
    assert [(r["band"], r["games"]) for r in totals] == [(sequences.RESTED, 1)]
    assert rows(slices.after_loss(frame))[0]["after_games"] == 3


def test_rest_days(tables, data, block_bits):
    got = {(r["team_id"], r["match_id"]): r["rest_days"]
           for r in rows(slices.rest_days(appearances(tables)))}
    want = {}
    for team, games in history(data).items():
        for i, game in enumerate(games):
            want[team, game[1]] = (game[0] - games[i - 1][0]).days if i else None
    assert got == want


def test_preceded_by_loss(tables, data, block_bits):
    got = {(r["team_id"], r["match_id"]): r["preceded_by_loss"]
           for r in rows(slices.preceded_by_loss(appearances(tables)))}
    want = {}
    for team, games in history(data).items():
        for i, game in enumerate(games):
            want[team, game[1]] = games[i - 1][4] if i else None
    assert got == want


def test_after_loss(tables, data, block_bits):
    got = {(r["team_id"], r["competition"]):
           (r["after_games"], r["after_points"], r["all_games"], r["all_points"])
           for r in rows(slices.after_loss(appearances(tables)))}
    want = {}
    for team, games in history(data).items():
        for league, name in ((1, "One"), (2, "Two")):
            after = [g for i, g in enumerate(games) if g[2] == league and i and games[i - 1][4]]
            if any(g[2] == league for g in games):
                want[team, name] = (len(after), sum(g[3] for g in after),
                                    len(games), sum(g[3] for g in games))
    assert got == want


def test_running_points(tables, data, block_bits):
    got = {(r["team_id"], r["match_id"]): (r["matchweek"], r["cumulative_points"])
           for r in rows(slices.running_points(appearances(tables)))}
    want = {}
    for team, games in history(data).items():
        for league in (1, 2):
            total = 0
            for number, game in enumerate([g for g in games if g[2] == league], 1):
                total += game[3]
                want[team, game[1]] = (number, total)
    assert got == want


def test_reports_do_not_depend_on_the_slices(tables, monkeypatch):
    def reports():
        return [rows(build(tables)) for build in (
            sequences.schedule_density, sequences.bounce_back, sequences.competitive_balance)]

    monkeypatch.setattr(slices, "BLOCK_BITS", 2)
    many = reports()
    monkeypatch.setattr(slices, "BLOCK_BITS", 22)
    assert many == reports()


def test_spread_of_points(tables, data):
    weeks = defaultdict(list)
    for games in history(data).values():
        for league, name in ((1, "One"), (2, "Two")):
            total = 0
            for number, game in enumerate([g for g in games if g[2] == league], 1):
                total += game[3]
                weeks[name, number].append(total)
    got = {(r["competition"], r["matchweek"]): (r["teams"], r["points_stdev"])
           for r in rows(sequences.competitive_balance(tables))}
    assert set(got) == {key for key, totals in weeks.items() if len(totals) >= 2}
    for key, (teams, stdev) in got.items():
        totals = weeks[key]
        mean = Fraction(sum(totals), len(totals))
        exact = float(sum((t - mean) ** 2 for t in totals) / len(totals)) ** 0.5
        assert teams == len(totals) and abs(stdev - exact) <= 0.005 + 1e-9


def test_last_five_games(tables, data):
    letters = {3: "W", 1: "D", 0: "L"}
    got = {r["team"]: (r["form"], r["points"]) for r in rows(outcomes.team_form(tables))}
    assert got == {
        f"Team {team:02}": ("".join(letters[g[3]] for g in games[-5:]),
                            sum(g[3] for g in games[-5:]))
        for team, games in history(data).items()
    }


def test_attack_ranks(tables, data):
    scored = defaultdict(list)
    for team, games in history(data).items():
        for g in games:
            scored[g[2], team].append(g[5])
    means = {key: Fraction(sum(goals), len(goals)) for key, goals in scored.items()}
    want = {}
    for (league, team), mean in means.items():
        peers = [m for (other, _), m in means.items() if other == league]
        want[f"L{league}", team] = (1 + sum(m > mean for m in peers), len(peers))
    got = {(r["competition_code"], r["team_id"]): (r["attack_rank"], r["league_size"])
           for r in rows(sequences.attack_tier(tables))}
    assert got == want


def test_rank_with_many_ties(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), i, rng.randint(0, 4), rng.randint(-1, 1), rng.randint(0, 2))
            for i in range(300)]
    frame = spark.createDataFrame(data, "g string, i int, x long, y long, z long")
    got = {r["i"]: r["place"] for r in rows(rank_within(frame, ["g"], ["x", "y", "z"], "place"))}
    assert got == {
        i: 1 + sum(other[0] == g and tuple(other[2:]) > (x, y, z) for other in data)
        for g, i, x, y, z in data
    }


def test_rank_by_one_column(spark):
    frame = spark.createDataFrame([("a", 3), ("a", 3), ("a", 1), ("b", 1)], "g string, x long")
    got = sorted((r["g"], r["x"], r["place"]) for r in rows(rank_within(frame, ["g"], ["x"], "place")))
    assert got == [("a", 1, 3), ("a", 3, 1), ("a", 3, 1), ("b", 1, 1)]
