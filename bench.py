"""Benchmark: the reports over stored tables.

Reads ``$BENCH_SF_DIR``, derives the match tables, writes them once (timed as
``build_tables``) and then times each report, best of two runs after a warm-up.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import time

from checks import fixture
from checks.session import local_session
from touchline.plans import documented, goals, outcomes, sequences
from touchline.sources.scratch import materialize
from touchline.tables import MatchTables

REPORTS = {
    "summary": outcomes.summary,
    "competitions": outcomes.competitions,
    "standings": outcomes.standings,
    "standings_through_matchday": lambda t: outcomes.standings(t, None, 12),
    "standings_league": lambda t: outcomes.standings(t, "EU"),
    "matchday_bounds": outcomes.matchday_bounds,
    "team_form": outcomes.team_form,
    "home_away_splits": outcomes.home_away_splits,
    "top_scoring_teams": goals.top_scoring_teams,
    "goals_by_month": goals.goals_by_month,
    "high_scoring_matches": goals.high_scoring_matches,
    "clean_sheet_leaders": goals.clean_sheet_leaders,
    "schedule_density": sequences.schedule_density,
    "bounce_back": sequences.bounce_back,
    "competitive_balance": sequences.competitive_balance,
    "efficiency_matrix": goals.efficiency_matrix,
    "defensive_solidity": sequences.defensive_solidity,
    "outcome_rates": documented.outcome_rates,
    "comeback_wins": documented.comeback_wins,
    "team_performance_summary": documented.team_performance_summary,
}
RUNS = 2


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(
        os.environ.get("BENCH_CPUS", "8"),
        **{"spark.python.sql.dataFrameDebugging.enabled": "false"},
    )
    derived = fixture.tables(spark, sf_dir)
    tables = {}

    def build() -> None:
        for name in ("competitions", "teams", "wide"):
            tables[name] = materialize(getattr(derived, name), f"bench-{name}")

    seconds = {"build_tables": timed(build)}
    stored = MatchTables.from_wide(**tables)
    matches = stored.matches.count()
    for name, report in REPORTS.items():
        report(stored).collect()
        seconds[name] = min(timed(lambda: report(stored).collect()) for _ in range(RUNS))
    print(json.dumps({
        "metric": "match reports, total time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(value, 3) for name, value in seconds.items()},
        "sf": os.path.basename(os.path.normpath(sf_dir)),
        "matches": matches,
    }))


if __name__ == "__main__":
    main()
