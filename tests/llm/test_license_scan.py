"""License scans next to their SQL, on rows of their own."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import duckdb

from tests.llm.test_operators import SCHEMA, same
from touchline.llm import license_scan, queries

TITLES = [(1, "The MIT License (MIT)"), (2, "see the MIT\nlicense, under the MIT license"), (3, "the mit licenses"), (4, None),
          (4, "the mit license"), (4, "the mit license"), (5, "Apache License Version 2, the MIT License"), (6, "no license"),
          (None, "the mit license, CC BY NC")]


def beside_sql(spark, folder, name, rows):
    """The query's rows on these documents, which are those of its SQL."""
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    found = queries.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    assert found.columns == [c[0] for c in cursor.description]
    same(found, cursor.fetchall())
    return found


def test_named_licenses_are_found(spark, tmp_path):
    """A license that is only named: no base place, but a label, the score 1 and a place."""
    found = beside_sql(spark, tmp_path, "op8_license_scan", TITLES)
    same(found.drop("n_words"), [
        (1, 0, None, None, "", "mit", 1.0, 1, 0, 0), (2, 1, 4, 4, "mit", "mit", 1.0, 2, 1, 5), (3, 0, None, None, "", "", 0.0, 0, None, None),
        (4, 0, None, None, "", "", 0.0, 0, None, None), (4, 0, None, None, "", "mit", 1.0, 1, 0, 0),
        (4, 0, None, None, "", "mit", 1.0, 1, 0, 0), (5, 1, 0, 0, "apache-2", "apache-2,mit", 1.0, 2, 0, 4),
        (6, 0, None, None, "", "", 0.0, 0, None, None), (None, 1, 3, 3, "cc-by-nc", "cc-by-nc,mit", 1.0, 2, 0, 3)])


def test_named_licenses_are_found_before_a_wrapped_notice(spark, tmp_path):
    # Notice 5, of the GNU lesser license, lacks the word that tells it from others.
    rows = [(32, "The MIT License (MIT)"), (32, "The MIT License (MIT)"), (59, "under the MIT license"), (5, "no license"),
            (5, None), (None, "the mit license"), (3, "Apache License Version 2, the MIT License")]
    found = beside_sql(spark, tmp_path, "op8_license_scan_wrapped", rows)
    names = [r for r in found.collect() if r["doc_id"] == 32]
    assert [(r["n_base"], r["labels"], r["score"], r["n_named"], r["first_named"]) for r in names] == [(0, "mit", 1.0, 1, 0)] * 2


def test_base_phrases_hold_a_name_with_their_label():
    for phrase, label in license_scan.PHRASES.items():
        assert any(name in phrase and label == own for name, own in license_scan.NAMED.items())


SIDE_BY_SIDE = [
    (1, "Licensed under the Apache License, Version 2.0. Licensed under the GNU Lesser General Public License.", "apache-2,lgpl"),
    (2, "Licensed under a Creative Commons Attribution 4.0 International License.\n"
        "Licensed under the GNU Lesser General Public License.", "cc-by,lgpl"),
    (3, "Licensed under the Apache License, Version 2.0, or this work is licensed under the GNU General Public License version 3, "
        "or licensed under a Creative Commons Attribution 4.0 International License.", "apache-2,cc-by,gpl-3"),
    (4, "Distributed under the Boost Software License, Version 1.0. See accompanying file or copy at\n"
        "licensed under the GNU Affero General Public License version 3", "agpl-3,bsl-1")]


def test_notices_side_by_side_are_all_found(spark):
    rows = [(k, around + text + around) for k, text, _ in SIDE_BY_SIDE for around in ("", "\n" + "x " * 500)]
    got = Counter((r["id"], r["labels"]) for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == Counter([(k, labels) for k, _, labels in SIDE_BY_SIDE] * 2)


def test_each_copy_of_a_notice_is_a_match(spark):
    rows = [(k, (text + " ") * 3) for k, (_, text) in enumerate(license_scan.TEMPLATES)]
    found = license_scan.matches(spark.createDataFrame(rows, SCHEMA))
    got = {r["id"]: r["count"] for r in found.groupBy("id").count().collect()}
    assert got == {k: 3 for k in range(len(rows))}


def plain_matches(text):
    """The notices of a text, the best first; none overlaps a better one."""
    words, windows = text.split(), []
    for k, (label, notice) in enumerate(license_scan.TEMPLATES):
        own, pairs = set(notice.split()), set(zip(notice.split(), notice.split()[1:]))
        reach = int(len(notice.split()) / 0.8 + 1e-9)
        for i, word in enumerate(words):
            held = set(words[i:i + reach]) & own
            if word in own and len(held) >= 0.8 * len(own) - 1e-9 and held >= set(license_scan.SIGNS[k]):
                end = max(words.index(w, i) for w in held)
                breaks = sum(p not in pairs for p in zip(words[i:end], words[i + 1:end + 1]))
                windows.append(((len(held) / len(own), len(own), -k, -breaks, end - i), i, end))
    kept = []
    for rank, i, end in sorted(windows, key=lambda w: (*[-x for x in w[0]], w[1])):
        # Equal ones that overlap stay both at first, then the first of them counts.
        if not any(i <= e and s <= end and r > rank for r, s, e in kept):
            kept.append((rank, i, end))
    return {(-r[2], s, e, round(r[0], 9)) for r, s, e in kept
            if not any(o[2] == r[2] and a < s <= b for o, a, b in kept)}


def test_matches_are_those_of_a_plain_search(spark, tmp_path):
    draw = random.Random(8)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()})
    docs = []
    for k in range(90):
        some = []
        for _ in range(draw.randint(1, 4)):
            some += [w for w in draw.choice(license_scan.TEMPLATES)[1].split() if draw.random() < 0.95]
            some += draw.choices(vocabulary + ["x"] * 60, k=draw.choice([0, 0, 1, 9]))
        docs.append((k, " ".join(w + "\n" * (draw.random() < 0.2) for w in some)))
    got = defaultdict(set)
    for r in license_scan.matches(spark.createDataFrame(docs + docs[:5], SCHEMA)).collect():
        got[r["id"]].add((r["template"], r["start"], r["end"], round(r["containment"], 9)))
    assert {k: got[k] for k, _ in docs} == {k: plain_matches(text) for k, text in docs}
    found = beside_sql(spark, tmp_path, "op8_license_scan", docs + docs[:5])
    assert any("," in r["labels"] for r in found.collect())
