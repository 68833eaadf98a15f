"""The pipeline against its plain version."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.test_operators import BPE, SCHEMA, texts


def plain(docs):
    docs = [d for d in docs if brute.quality(d[1])[-1]]
    named = brute.components(docs)
    docs = sorted({(d, t) for (d, t), (_, _, c) in zip(docs, named) if d is not None and d == c})
    first, left = {}, []
    for d, t in docs:
        w = brute.words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i:i + 13]), d)
    for d, t in docs:
        w = brute.words(t)
        gone = {p for i in range(len(w) - 12) if first[tuple(w[i:i + 13])] < d for p in range(i, i + 13)}
        left.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    return left


def test_pipeline(spark, tmp_path):
    rows = [(d, t) for d, t in texts() if d is not None]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns(
        {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.char_length("text").cast("long"),
         "id": F.lit(1), "kept": F.lit("y"), "rest": F.lit(2.5)})
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns
        docs.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{number}")
    want = plain(rows)
    assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(want)
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = brute.token_pieces(want, Tokenizer.from_file(BPE))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == Counter(pieces)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA + ", lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
