import json

import pytest

from checks.session import local_session


@pytest.fixture(scope="session")
def spark():
    # Tiny inputs: compiling generated code would take most of the time.
    quick = {
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.sql.shuffle.partitions": "4",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    return local_session("8", **quick)


def raw_match(mid, home=(1, "Home"), away=(2, "Away"), ft=(1, 0), ht=(0, 0), winner="auto",
              status="FINISHED", date="2025-09-01T13:00:00Z", code="PL", name="Premier League",
              matchday=1, season="2025-08-17", referees=("Ref",)):
    """One feed record; ``winner="auto"`` follows the full-time score."""
    if winner == "auto":
        winner = "HOME_TEAM" if ft[0] > ft[1] else "AWAY_TEAM" if ft[1] > ft[0] else "DRAW"
    return {
        "id": mid,
        "competition": {"code": code, "name": name},
        "season": {"startDate": season, "endDate": "2026-05-30"},
        "utcDate": date,
        "status": status,
        "matchday": matchday,
        "homeTeam": {"id": home[0], "name": home[1]},
        "awayTeam": {"id": away[0], "name": away[1]},
        "score": {
            "fullTime": {"home": ft[0], "away": ft[1]},
            "halfTime": None if ht is None else {"home": ht[0], "away": ht[1]},
            "winner": winner,
        },
        "referees": [{"name": ref, "type": "REFEREE"} for ref in referees],
    }


@pytest.fixture
def landed(spark, tmp_path):
    """Write matches as one response and read them back as raw matches."""
    from touchline.sources.feed import read_matches_json

    def land(*matches):
        path = tmp_path / f"feed-{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps({"matches": list(matches)}) + "\n")
        return read_matches_json(spark, str(path))

    return land


@pytest.fixture
def transformed(landed):
    from touchline.operators.transform import transform_matches

    return lambda *matches: transform_matches(landed(*matches))


@pytest.fixture
def tables(spark, transformed, tmp_path):
    """The tables after loading the given matches into a new store."""
    from touchline.sources.store import MatchStore

    def build(*matches):
        path = tmp_path / f"store-{len(list(tmp_path.iterdir()))}"
        store = MatchStore(spark, str(path))
        store.load(transformed(*matches))
        return store.tables()

    return build


def rows(frame):
    return [row.asDict() for row in frame.collect()]
