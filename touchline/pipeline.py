"""One run: landed feed files → clean matches → stored tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from touchline.operators.transform import extract_teams, transform_matches
from touchline.schema import HIGH_SCORE_THRESHOLD
from touchline.sources.feed import league_scope, read_matches_json, season_scope
from touchline.sources.scratch import Scratch
from touchline.sources.store import MatchStore, load_facts


@dataclass(frozen=True)
class RunResult:
    """Counts of a run. ``matches`` counts transformed matches, new or not;
    ``unreadable`` the responses that are not valid JSON."""

    matches: int = 0
    teams: int = 0
    competitions: int = 0
    inserted: int = 0
    unreadable: int = 0


def run(raw: DataFrame, store: MatchStore, league: str | None = None, season: int | None = None,
        threshold: int = HIGH_SCORE_THRESHOLD, load_id: str | None = None) -> RunResult:
    """Transform and load raw matches; a run without matches writes nothing."""
    scoped = season_scope(league_scope(raw, league), season)
    with Scratch(store.spark, "run") as scratch:
        # Counted by the tasks that write; the set has one entry per league.
        leagues = F.size(F.collect_set("competition_code"))
        matches, facts = scratch.materialize_observed(
            transform_matches(scoped, threshold), "matches", {**load_facts(), "leagues": leagues})
        if not facts["rows"]:
            return RunResult()
        teams, found = scratch.materialize_observed(
            extract_teams(matches), "teams", {"teams": F.count("*")})
        inserted = store.load_written(matches, teams, load_id, facts)
    return RunResult(facts["rows"], found["teams"], facts["leagues"], inserted)


def run_landed(paths: str | list[str], store: MatchStore, multi_line: bool = False,
               by_league: bool = False, **options) -> RunResult:
    """``run`` over landed responses; those that cannot be read are counted as they are read.

    With ``by_league`` the files lie under ``league=<code>`` folders, and a run of one
    league opens only its own.
    """
    bad = Observation()
    league = options.get("league") if by_league else None
    raw = read_matches_json(store.spark, paths, multi_line, league=league, bad=bad)
    return replace(run(raw, store, **options), unreadable=bad.get["unreadable"])
