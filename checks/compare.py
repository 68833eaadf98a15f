"""Run queries next to their SQL: ``python -m checks.compare [sf_dir] [names…]``."""

from __future__ import annotations

import sys
import time

import duckdb

from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def expected(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    return [column[0] for column in cursor.description], cursor.fetchall()


def normal(columns, rows):
    """Rows with columns by name, sorted; -0.0 and 0 kept apart by ``repr``."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([row[i] for i in order]) for row in rows)


def difference(spark, sf_dir: str, name: str) -> str | None:
    """None when both sides agree, else what differs."""
    frame = QUERIES[name](spark, sf_dir)
    got_columns, got = normal(frame.columns, [tuple(row) for row in frame.collect()])
    want_columns, want = normal(*expected(sf_dir, ORACLES[name]))
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for left, right in zip(got, want):
        if left != right:
            return f"{left} != {right}"
    return None if want else "no rows on either side"


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    from checks.session import local_session

    spark = local_session()
    failures = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            problem = difference(spark, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {time.time() - start:6.2f}s {name} "
              f"{problem or ''}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
