import datetime as dt

import pytest

from tests.conftest import raw_match, rows
from touchline.operators.merge import merge_league_snapshots, rank_leagues
from touchline.operators.transform import extract_teams
from touchline.pipeline import RunResult, run, run_landed
from touchline.sources import scratch, snapshots
from touchline.sources.store import MatchStore
from touchline.streaming.ingest import ingest_landed


@pytest.fixture
def store(spark, tmp_path):
    return MatchStore(spark, str(tmp_path / "store"))


def scores(tables):
    return {r["id"]: r["home_score_ft"] for r in rows(tables.matches)}


def test_loading_twice_changes_nothing(store, transformed):
    first = transformed(raw_match(1, ft=(1, 0)), raw_match(2, ft=(2, 0)))
    again = transformed(raw_match(1, ft=(7, 0)), raw_match(3, ft=(3, 0)))
    assert store.load(first) == 2
    assert store.load(first) == 0
    assert store.load(again) == 1
    tables = store.tables()
    assert scores(tables) == {1: 1, 2: 2, 3: 3}
    assert tables.match_metrics.count() == 3
    assert tables.teams.count() == 2
    assert tables.competitions.count() == 1


def test_stored_names_stay(store, transformed):
    store.load(transformed(raw_match(1, home=(1, "Old"), name="Old League")))
    store.load(transformed(raw_match(2, home=(1, "New"), name="New League")))
    tables = store.tables()
    assert {r["id"]: r["name"] for r in rows(tables.teams)}[1] == "Old"
    assert [r["name"] for r in rows(tables.competitions)] == ["Old League"]


def test_competition_ids_go_on(store, transformed):
    store.load(transformed(raw_match(1, code="SA", name="Serie A")))
    store.load(transformed(raw_match(2, code="PL"), raw_match(3, code="BL1", name="Bundesliga")))
    tables = store.tables()
    assert {r["code"]: r["id"] for r in rows(tables.competitions)} == {"SA": 1, "BL1": 2, "PL": 3}
    assert {r["id"]: r["competition_id"] for r in rows(tables.matches)} == {1: 1, 2: 3, 3: 2}


def test_empty_load_writes_nothing(store, transformed):
    assert store.load(transformed()) == 0
    assert store.tables().matches.isEmpty()


def test_same_load_id_is_loaded_once(store, transformed):
    assert store.load(transformed(raw_match(1)), load_id="monday") == 1
    assert store.load(transformed(raw_match(2)), load_id="monday") == 0
    assert scores(store.tables()) == {1: 1}


def test_missing_keys_fail_the_load(store, transformed):
    with pytest.raises(ValueError, match="match id"):
        store.load(transformed(raw_match(None)))
    with pytest.raises(ValueError, match="away team name"):
        store.load(transformed(raw_match(1, away=(2, None))))
    assert store.tables().matches.isEmpty()


def test_failed_load_is_invisible_and_can_be_repeated(spark, store, transformed, monkeypatch):
    store.load(transformed(raw_match(1)))
    with monkeypatch.context() as broken:
        broken.setattr(MatchStore, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.load(transformed(raw_match(2)), load_id="two")
    assert scores(store.tables()) == {1: 1}
    assert store.load(transformed(raw_match(2)), load_id="two") == 1
    assert scores(store.tables()) == {1: 1, 2: 1}


def test_run_counts_transformed_matches(store, landed):
    raw = landed(raw_match(1), raw_match(2, home=(3, "Third")), raw_match(3, code="SA"))
    assert run(raw, store, league="PL") == RunResult(2, 3, 1, 2)
    assert run(raw, store, league="PL") == RunResult(2, 3, 1, 0)
    assert run(raw, store, league="XX") == RunResult()
    assert run(raw, store, season=1999) == RunResult()


def test_snapshots_merge_keeps_the_last_league(spark, transformed, tmp_path):
    base = str(tmp_path / "snapshots")
    day, later = dt.date(2026, 8, 13), dt.date(2026, 8, 14)

    def write(league, when, *matches):
        frame = transformed(*matches)
        assert snapshots.write_league_snapshot(base, frame, when, league) == len(matches)

    write("PL", day, raw_match(1, ft=(1, 0)), raw_match(8, ft=(8, 0)))
    write("PL", later, raw_match(1, ft=(2, 0)), raw_match(2, ft=(5, 0)))
    write("SA", day, raw_match(2, ft=(6, 0), code="SA", name="Serie A", home=(1, "One")),
          raw_match(3, code="PL", name="Prem"))
    write(None, later, raw_match(9))
    merged = snapshots.read_merged(spark, base)
    codes = {r["id"]: r["code"] for r in rows(merged.competitions)}
    assert codes == {1: "PL", 2: "SA"}
    assert {r["id"]: (r["home_score_ft"], codes[r["competition_id"]])
            for r in rows(merged.matches)} == {1: (2, "PL"), 2: (6, "SA"), 3: (1, "PL")}
    assert {r["name"] for r in rows(merged.competitions)} == {"Prem", "Serie A"}
    assert {r["id"]: r["name"] for r in rows(merged.teams)}[1] == "One"
    assert merged.match_metrics.count() == 3


def test_snapshot_of_the_same_day_is_replaced(spark, transformed, tmp_path):
    base = str(tmp_path / "snapshots")
    day = dt.date(2026, 8, 13)
    snapshots.write_league_snapshot(base, transformed(raw_match(1), raw_match(2)), day, "PL")
    snapshots.write_league_snapshot(base, transformed(raw_match(3)), day, "PL")
    assert scores(snapshots.read_merged(spark, base)) == {3: 1}


def test_no_snapshots_at_all_is_an_error(spark, transformed, tmp_path):
    with pytest.raises(FileNotFoundError):
        snapshots.read_merged(spark, str(tmp_path / "none"))
    base = str(tmp_path / "other")
    snapshots.write_league_snapshot(base, transformed(raw_match(1)), dt.date(2026, 1, 1), "XX")
    with pytest.raises(FileNotFoundError):
        snapshots.read_merged(spark, base)


def test_empty_run_writes_no_snapshot(spark, transformed, tmp_path):
    base = tmp_path / "snapshots"
    assert snapshots.write_league_snapshot(str(base), transformed(), dt.date(2026, 1, 1)) == 0
    assert not base.exists()


def test_merge_without_metrics_and_without_competitions(spark, tables):
    loaded = tables(raw_match(1), raw_match(2))
    from pyspark.sql import functions as F

    def of(frame, league):
        return rank_leagues(frame.withColumn("league", F.lit(league)))

    none = of(loaded.competitions, "PL").limit(0)
    both = of(loaded.matches, "PL").unionByName(of(loaded.matches.withColumn(
        "id", F.col("id") + 10), "SA"))
    merged = merge_league_snapshots(of(loaded.competitions, "PL"), of(loaded.teams, "PL"), both)
    assert sorted(scores(merged)) == [1, 2]
    assert merged.match_metrics.isEmpty()
    with pytest.raises(ValueError):
        merge_league_snapshots(none, of(loaded.teams, "PL"), both.limit(0))


def test_stream_loads_each_file_once(spark, tmp_path):
    import json

    landing, store = tmp_path / "landing", MatchStore(spark, str(tmp_path / "store"))
    landing.mkdir()
    (landing / "a.json").write_text(json.dumps({"matches": [raw_match(1), raw_match(2)]}) + "\n")

    def ingest():
        query = ingest_landed(spark, str(landing), store, str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120)
        if query.exception():
            raise query.exception()

    ingest()
    assert sorted(scores(store.tables())) == [1, 2]
    (landing / "b.json").write_text(
        json.dumps({"matches": [raw_match(2, ft=(9, 0)), raw_match(3)]}) + "\n"
    )
    ingest()
    assert scores(store.tables()) == {1: 1, 2: 1, 3: 1}
    ingest()
    assert store.tables().matches.count() == 3


def test_teams_may_be_given(store, transformed):
    matches = transformed(raw_match(1))
    store.load(matches, extract_teams(matches))
    assert store.tables().teams.count() == 2


def test_failed_repeat_leaves_the_snapshot(spark, tmp_path, transformed, monkeypatch):
    base, day = str(tmp_path / "snaps"), dt.date(2026, 1, 1)
    snapshots.write_league_snapshot(base, transformed(raw_match(1), raw_match(2)), day, "PL")

    def fails(rows):
        raise OSError("lost the storage")

    monkeypatch.setattr(snapshots, "extract_teams", fails)
    with pytest.raises(OSError):
        snapshots.write_league_snapshot(base, transformed(raw_match(3)), day, "PL")
    assert scores(snapshots.read_merged(spark, base)) == {1: 1, 2: 1}


def test_small_load_reads_only_batches_it_can_touch(spark, store, transformed, tmp_path):
    """The files of a batch with other ids are broken: a load does not notice."""
    store.load(transformed(raw_match(1), raw_match(2)), load_id="old")
    store.load(transformed(raw_match(1000), raw_match(1001)), load_id="new")
    old = store._commits().filter("load_id = 'old'").first()["batch"]
    files = list((tmp_path / "store" / "matches" / f"batch={old}").rglob("*.parquet"))
    assert files
    for file in files:
        file.write_bytes(b"broken")
        (file.parent / f".{file.name}.crc").unlink()
    assert store.load(transformed(raw_match(1001), raw_match(1002))) == 1
    with pytest.raises(Exception):
        store.tables().matches.collect()


def test_compaction_changes_no_row(spark, store, transformed):
    store.load(transformed(raw_match(1, ft=(1, 0)), raw_match(2, ft=(2, 0))))
    store.load(transformed(raw_match(3, ft=(3, 0), code="SA", name="Serie A")), load_id="late")
    before = [sorted(map(str, rows(t))) for t in (store.tables().matches, store.tables().teams,
                                        store.tables().competitions)]
    store.compact()
    after = [sorted(map(str, rows(t))) for t in (store.tables().matches, store.tables().teams,
                                       store.tables().competitions)]
    assert after == before
    assert store._live().count() == 1
    assert store.load(transformed(raw_match(3, ft=(9, 0)), raw_match(4, ft=(4, 0)))) == 1
    assert store.load(transformed(raw_match(5)), load_id="late") == 0
    assert scores(store.tables()) == {1: 1, 2: 2, 3: 3, 4: 4}


def test_no_scratch_stays_and_unreadable_responses_are_counted(spark, tmp_path, monkeypatch):
    import json
    import os

    landed = tmp_path / "landed"
    landed.mkdir()
    good = json.dumps({"matches": [raw_match(1), raw_match(2)]})
    (landed / "a.json").write_text(good + "\n" + good[:40] + "\n")
    store = MatchStore(spark, str(tmp_path / "store"))
    monkeypatch.setattr(scratch, "scratch_dir", lambda spark: str(tmp_path / "scratch"))
    result = run_landed(str(landed), store)
    assert (result.matches, result.inserted, result.unreadable) == (2, 2, 1)
    assert os.listdir(tmp_path / "scratch" / "touchline") == []


def test_merged_tables_are_written_once(spark, transformed, tmp_path):
    base, target = str(tmp_path / "snapshots"), str(tmp_path / "merged")
    snapshots.write_league_snapshot(base, transformed(raw_match(1), raw_match(2)),
                                    dt.date(2026, 1, 1), "PL")
    merged = snapshots.read_merged(spark, base, target=target)
    text = merged.facts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Window" not in text
    assert all(target in file for file in merged.matches.inputFiles())
