"""The store's index of ids, its numbered commits and overlapping writers; merged snapshots
and stored results that follow them; averages over known values."""

import datetime as dt
import json
import re
import threading

import pytest
from pyspark.sql import functions as F

from tests.conftest import raw_match, rows
from touchline.functions.bitmaps import bitmaps, has_bit
from touchline.functions.rounding import folded_mean, mean, ratio, with_known
from touchline.operators import load
from touchline.plans.dispatch import StoredReports
from touchline.sources import merged, snapshots
from touchline.sources.paths import create_new
from touchline.sources.store import MatchStore
from touchline.streaming.ingest import ingest_landed, unreadable_landed, unreadable_path


@pytest.fixture
def store(spark, tmp_path):
    return MatchStore(spark, str(tmp_path / "store"))


def scores(tables):
    return {r["id"]: r["home_score_ft"] for r in rows(tables.matches)}


def once(tables):
    """No match, team, competition or competition number is there twice."""
    for table, key in ((tables.matches, "id"), (tables.teams, "id"), (tables.competitions, "id"),
                       (tables.competitions, "code")):
        keys = [r[key] for r in rows(table)]
        assert len(keys) == len(set(keys))


def test_bitmaps_hold_exactly_their_numbers(spark):
    numbers = [0, 1, 2, 32767, 32768, 32769, 10**12, 2**62, -1, -40000]
    index = bitmaps(spark.createDataFrame([(n,) for n in numbers], "id long"), "id")
    asked = spark.createDataFrame([(n + d,) for n in numbers for d in (-1, 0, 1)], "id long").distinct()
    placed = asked.withColumn("block", F.bitmap_bucket_number("id")).join(index, "block")
    got = {r["id"] for r in placed.filter(has_bit(F.col("bitmap"), F.col("id"))).collect()}
    assert got == {n for n in numbers}


def test_a_load_opens_no_file_of_matches(store, transformed, tmp_path):
    """Leagues whose ids lie between one another: every file of matches is broken, and a load
    still knows which ids are stored."""
    store.load(transformed(*[raw_match(n) for n in range(0, 60, 3)]))
    store.load(transformed(*[raw_match(n, code="SA") for n in range(1, 60, 3)]))
    for file in (tmp_path / "store" / "matches").rglob("*.parquet"):
        file.write_bytes(b"broken")
        (file.parent / f".{file.name}.crc").unlink()
    assert store.load(transformed(*[raw_match(n) for n in range(0, 12)])) == 4
    with pytest.raises(Exception):
        store.tables().matches.collect()


def test_ids_of_any_size(store, transformed):
    ids = [0, 5, -7, 2**62, 2**62 + 1]
    assert store.load(transformed(*[raw_match(n) for n in ids])) == 5
    assert store.load(transformed(*[raw_match(n + d) for n in ids for d in (0, 2)])) == 5
    assert len(scores(store.tables())) == 10


class Overlapping(MatchStore):
    """Another writer commits after this one has staged its first batch."""

    other = None
    staged = 0

    def _stage(self, *args):
        batch = super()._stage(*args)
        self.staged += 1
        if self.staged == 1:
            self.other(MatchStore(self.spark, self.path))
        return batch


@pytest.mark.parametrize("theirs, staged, added", [
    # Nothing in common: the batch is committed under the next number.
    ([raw_match(8, home=(7, "Seven"), away=(8, "Eight"))], 1, 2),
    ([raw_match(1, ft=(9, 0), home=(7, "Seven"), away=(8, "Eight"))], 2, 1),  # a match
    ([raw_match(8)], 2, 2),  # teams
    ([raw_match(8, home=(7, "Seven"), away=(8, "Eight"), code="SA", name="Serie A")], 2, 2),  # numbers
])
def test_loads_that_overlap(spark, store, transformed, theirs, staged, added):
    store.load(transformed(raw_match(100, home=(50, "Fifty"), away=(51, "Fifty-one"))))
    mine = [raw_match(1, ft=(1, 0)), raw_match(2, ft=(2, 0), code="BL1" if theirs[0]["competition"]["code"] == "SA" else "PL")]
    slow = Overlapping(spark, store.path)
    slow.other = lambda other: other.load(transformed(*theirs), load_id="theirs")
    assert slow.load(transformed(*mine), load_id="mine") == added
    assert slow.staged == staged
    tables = store.tables()
    once(tables)
    assert set(scores(tables)) == {100, 1, 2, theirs[0]["id"]}
    assert scores(tables)[1] == (9 if theirs[0]["id"] == 1 else 1)
    known = {r["id"] for r in rows(tables.competitions)}
    assert all(r["competition_id"] in known for r in rows(tables.matches))


def test_the_same_load_twice_at_once(spark, store, transformed):
    slow = Overlapping(spark, store.path)
    slow.other = lambda other: other.load(transformed(raw_match(1)), load_id="monday")
    assert slow.load(transformed(raw_match(1)), load_id="monday") == 0
    once(store.tables())


def test_writers_in_threads(spark, store, transformed):
    batches = [transformed(*[raw_match(n, code=code, home=(n % 5, f"T{n % 5}"), away=(9, "Nine"))
                             for n in range(first, 30, 2)]) for first, code in ((0, "PL"), (1, "SA"), (0, "FL1"))]
    threads = [threading.Thread(target=lambda b=b: MatchStore(spark, store.path).load(b)) for b in batches]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    once(store.tables())
    assert set(scores(store.tables())) == set(range(30))
    assert store.version() == 3


def test_a_number_is_given_once(spark, tmp_path):
    won = []
    path = str(tmp_path / "log" / "1.json")
    threads = [threading.Thread(target=lambda k=k: won.append((create_new(spark, path, f"{k}\n"), k)))
               for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winner, = [k for made, k in won if made]
    assert open(path).read() == f"{winner}\n"
    assert [f.name for f in (tmp_path / "log").iterdir() if "draft" in f.name] == []


def test_a_load_during_compaction(spark, store, transformed, monkeypatch):
    store.load(transformed(raw_match(1)))
    store.load(transformed(raw_match(2)))
    write, waiting = MatchStore._write, [True]

    def slow(self, name, *args, **kwargs):
        if name == "ids" and waiting:
            waiting.clear()
            MatchStore(spark, store.path).load(transformed(raw_match(3)))
        return write(self, name, *args, **kwargs)

    monkeypatch.setattr(MatchStore, "_write", slow)
    store.compact()
    assert set(scores(store.tables())) == {1, 2, 3} and store._live().count() == 2
    once(store.tables())
    assert store.load(transformed(raw_match(1), raw_match(2), raw_match(3))) == 0


def test_temporary_tables_go(spark, tmp_path, monkeypatch):
    import os

    from touchline.sources import scratch

    monkeypatch.setattr(scratch, "scratch_dir", lambda spark: str(tmp_path / "scratch"))
    first = scratch.materialize(spark.range(5), "first")
    with scratch.temporary_tables(spark) as keep:
        inner = scratch.materialize(first.filter("id > 1"), "inner")
        result = keep(scratch.materialize(inner.selectExpr("id * 2 AS id"), "result"))
    assert sorted(r["id"] for r in result.collect()) == [4, 6, 8]
    assert sorted(name.split("-")[0] for name in os.listdir(tmp_path / "scratch" / "touchline")) == ["first", "result"]


def test_pivot_needs_a_column_for_each_competition(spark):
    from touchline.plans.shape import parity_pivot

    rows_ = spark.createDataFrame([("A", 1, 2, 0.5), ("B", 1, 2, 1.5)],
                                  "competition string, matchweek long, teams long, points_stdev double")
    names = spark.createDataFrame([("B",), ("A",)], "name string")
    assert [tuple(r) for r in parity_pivot(rows_, names).collect()] == [(1, 0.5, 1.5)]
    assert [tuple(r) for r in parity_pivot(rows_, ["B", "A"]).collect()] == [(1, 1.5, 0.5)]
    with pytest.raises(Exception, match="No column for B"):
        parity_pivot(rows_, ["A"]).collect()


def test_tables_as_of_a_commit(store, transformed):
    store.load(transformed(raw_match(1)))
    store.load(transformed(raw_match(2)))
    assert set(scores(store.tables(1))) == {1} and set(scores(store.tables())) == {1, 2}


def test_stored_results_follow_the_store(spark, store, transformed, tmp_path, monkeypatch):
    from touchline.plans import dispatch

    ran = []
    build = dispatch.report
    monkeypatch.setattr(dispatch, "report", lambda *args: ran.append(args[1]) or build(*args))
    path = str(tmp_path / "reports")
    store.load(transformed(raw_match(1), raw_match(2)))
    first = StoredReports(store, path).report("standings")
    assert [r["team"] for r in rows(first)] == ["Home", "Away"]
    # Another session, no load meanwhile.
    assert rows(StoredReports(MatchStore(spark, store.path), path).report("standings")) == rows(first)
    assert len(ran) == 1
    for n, home in ((3, "Third"), (4, "Fourth")):
        store.load(transformed(raw_match(n, home=(n, home))))
        assert home in [r["team"] for r in rows(StoredReports(store, path).report("standings"))]
    assert len(ran) == 3
    kept = list((tmp_path / "reports").glob("standings-*/*.json"))
    assert len(kept) == 2  # the last one and the one before


def test_snapshots_are_chosen_without_a_shuffle(spark, transformed, tmp_path):
    """A shuffle by league or by snapshot would give one task all rows of a league."""
    base, target = str(tmp_path / "snapshots"), str(tmp_path / "merged")
    for day in (1, 2):
        for k, league in enumerate(("PL", "PD")):
            snapshots.write_league_snapshot(
                base, transformed(raw_match(k, code=league), raw_match(8 + day, code=league)),
                dt.date(2026, 8, day), league)
        got = merged.refresh_merged(spark, base, target, ("PL", "PD"), ("PL", "PD"))
        assert sorted(r["id"] for r in rows(got.matches)) == [0, 1, 8 + day]
    chosen = snapshots.latest_snapshots(spark, base)
    for frame in (snapshots.read_snapshots(spark, base, "matches", chosen), got.teams, got.matches):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and not re.search(r"hashpartitioning\((league|code)#", plan.split("BroadcastExchange")[0])


def test_refresh_merges_only_what_changed(spark, transformed, tmp_path):
    base, target = str(tmp_path / "snapshots"), str(tmp_path / "merged")
    order = ("PL", "PD", "SA")

    def write(league, day, *matches):
        snapshots.write_league_snapshot(base, transformed(*matches), dt.date(2026, 8, day), league)

    def refresh():
        got = merged.refresh_merged(spark, base, target, order, order)
        full = snapshots.read_merged(spark, base, order, order)
        for name in ("matches", "teams", "competitions", "match_metrics"):
            assert sorted(map(str, rows(getattr(got, name)))) == sorted(map(str, rows(getattr(full, name))))
        return merged.merged_parts(spark, target)

    teams = {"home": (3, "Three"), "away": (4, "Four")}
    write("PL", 1, raw_match(1), raw_match(2))
    write("PD", 1, raw_match(3, code="PD", **teams), raw_match(4, code="PD", **teams))
    write("SA", 1, raw_match(5, code="SA", home=(5, "Five"), away=(6, "Six")))
    number, first = refresh()
    assert refresh() == (number, first)  # nothing new, nothing written
    write("SA", 2, raw_match(5, ft=(7, 0), code="SA", home=(5, "Five"), away=(6, "Six")))
    number, second = refresh()
    assert {name for name in order if second[name]["matches"] != first[name]["matches"]} == {"SA"}
    # SA takes a match of PL, and gives it back: both are merged again, PD is not.
    write("SA", 3, raw_match(2, ft=(9, 0), code="SA", home=(5, "Five"), away=(6, "Six")))
    _, third = refresh()
    assert {name for name in order if third[name]["matches"] != second[name]["matches"]} == {"SA", "PL"}
    write("SA", 4, raw_match(5, code="SA", home=(5, "Five"), away=(6, "Six")))
    _, fourth = refresh()
    assert {name for name in order if fourth[name]["matches"] != third[name]["matches"]} == {"SA", "PL"}
    assert all(part["PD"]["teams"] == first["PD"]["teams"] for part in (second, third, fourth))


def test_stream_files_what_it_cannot_read(spark, store, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    good = json.dumps({"matches": [raw_match(1), raw_match(2)]})
    (landing / "a.json").write_text(good + "\n" + good[:40] + "\n")

    def ingest():
        query = ingest_landed(spark, str(landing), store, str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120)

    ingest()
    assert set(scores(store.tables())) == {1, 2}
    bad, = rows(unreadable_landed(spark, unreadable_path(store)))
    assert bad["response"] == good[:40] and bad["file"].endswith("a.json") and bad["micro_batch"] == 0
    (landing / "b.json").write_text("{broken\n{also\n")
    ingest()
    assert [r["micro_batch"] for r in rows(unreadable_landed(spark, unreadable_path(store)))].count(1) == 2
    assert set(scores(store.tables())) == {1, 2}
    assert rows(unreadable_landed(spark, str(tmp_path / "none"))) == []


def test_orphans_with_null_parents(spark, tables):
    t = tables(raw_match(1), raw_match(2))
    lost = t.matches.withColumn("home_team_id", F.when(F.col("id") == 1, F.lit(None)).otherwise(F.col("home_team_id")))
    got, = rows(load.orphan_checks(type(t)(t.competitions, t.teams.filter("name <> 'Away'"), lost, t.match_metrics)))
    assert got == {"no_match": 0, "no_competition": 0, "no_home_team": 1, "no_away_team": 2}


def test_averages_leave_unknown_values_out(spark):
    values = [1, None, -2, None, 4, 4]
    frame = spark.createDataFrame([(k % 2, v) for k, v in enumerate(values)], "k int, v long")
    got = frame.agg(mean("v").alias("m"), ratio(F.sum("v"), F.count("*")).alias("all")).first()
    assert (got["m"], got["all"]) == (1.75, 1.17)
    folded = with_known(frame, "v").groupBy("k").agg(F.sum("v").alias("v"), F.sum("known_v").alias("known_v"))
    assert folded.agg(folded_mean("v").alias("m")).first()["m"] == 1.75
    assert frame.filter("v is null").agg(mean("v").alias("m")).first()["m"] is None


@pytest.mark.parametrize("total, count, want", [(-1, 8, -0.13), (1, 8, 0.13), (-5, 2, -2.5), (0, 3, 0.0), (1, 0, None),
                                               (-1005, 1000, -1.01)])
def test_ratios_of_any_sign(spark, total, count, want):
    assert spark.range(1).select(ratio(F.lit(total), F.lit(count)).alias("r")).first()["r"] == want
