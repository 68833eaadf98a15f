"""Source audit, token alignment and exact duplicates against their plain versions."""

from __future__ import annotations

import importlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.test_operators import BPE, SCHEMA, WORDS, same, texts
from touchline.llm import exact_dedup, source_audit, token_alignment, tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")


CLASHES = ["id", "rest", "mark", "fp", "words", "length", "prefix", "full", "digest", "chunk", "payload", "data", "part", "rank",
           "ids", "block", "pair", "template", "start", "end", "alive", "plain", "kept", "component", "root"]


@pytest.mark.parametrize("name, run", [
    ("substring_dedup", lambda m, d: m.remove_repeats(d)), ("token_files", lambda m, d: m.token_file(d, WORDS)),
    ("imatch", lambda m, d: m.edited_likeness(d, low=0.05, high=0.5)), ("bwt_dedup", lambda m, d: m.remove_repeats(d)),
    ("suffix_quality", lambda m, d: m.quality(d)), ("simhash", lambda m, d: m.near_duplicates(d).drop("mark")),
    ("license_scan", lambda m, d: m.scan(d)), ("packing", lambda m, d: m.pack(d, BPE).drop("sequence_id", "offset")),
    ("token_alignment", lambda m, d: m.align(d, BPE, PIECES)), ("exact_dedup", lambda m, d: m.exact_duplicates(d, digest=True)),
    ("byte_bpe", lambda m, d: m.encode_decode(d, m.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
                                              public_tokenizers.PATTERN))])
def test_other_columns_change_nothing(spark, name, run):
    module = importlib.import_module(f"touchline.llm.{name}")
    plain = spark.createDataFrame([d for d in texts() if len(d[1] or "") < 500][:25], SCHEMA).coalesce(1)
    named = plain.select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)], F.lit("z").alias("a.b"))
    assert sorted(map(repr, run(module, named).collect())) == sorted(map(repr, run(module, plain).collect()))


# --- source audit --------------------------------------------------------------------

AUDIT = "text string, lang string, source string, term string, prefix string, count long"


def audit_rows():
    draw = random.Random(5)
    words = ["".join(draw.choice("abéß") for _ in range(draw.randint(1, 9))) for _ in range(150)]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for k in range(160):
        source = "s0" if k % 3 == 0 else f"s{draw.randint(1, 9)}"
        some = draw.choices(words[:40] if source == "s1" else words, weights[:40] if source == "s1" else weights,
                            k=draw.randint(0, 60))
        text = draw.choice([" ", "\n", "-1-"]).join(w.upper() if draw.random() < 0.2 else w for w in some)
        rows.append((text, draw.choice(["en", "en", "fr", None]), source))
    long_ = "x" * 5_000
    rows += [(long_ + end, "en", "s0") for end in ("a", "a", "b", "") for _ in range(4)]  # terms beyond many levels
    rows += [("ab ab", "xx", "only"), (None, "yy", None), ("", "yy", "empty"), ("lone", "yy", "t"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("tile, terms, bits", [(128, 8192, 1 << 25), (3, 7, 1 << 15)])
def test_source_audit(spark, monkeypatch, tile, terms, bits):
    monkeypatch.setattr(source_audit, "TILE", tile)
    monkeypatch.setattr(source_audit, "TERMS", terms)
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in audit_rows()], AUDIT).repartition(5)
    got = source_audit.audit(frame, least=4, top=6, bits=bits)
    want = brute.audit(audit_rows(), 4, 6)
    same(got, want)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert any("x" * 5000 in w[3] for w in want) and any(w[0] == "yy" and w[4] == 0 for w in want)


def test_blocks_are_sorted_and_small():
    """Documents are numbered by language and group, so that a pass over a block has no sort
    of entries by language; a group is stored once per document."""
    rows = audit_rows()
    made = source_audit.make_block(pa.array([r[0] for r in rows], pa.string()),
                                   [r[1] or "" for r in rows], [r[2] or "" for r in rows])
    block = source_audit.Block(dict(zip(("langs", "sources", "terms", "ends", "groups", "pairs"), made)))
    assert block.of_doc.size == len(rows) and (np.diff(block.of_group[block.of_doc]) >= 0).all()
    assert (np.diff(block.term.astype(np.int64) * len(rows) + block.doc) > 0).all()
    words = [block.prefix(k, 1 << 20) for k in range(block.starts.size)]
    assert words == sorted(words) and all(w.endswith(b"\0") and len(w) > 1 for w in words)
    want = Counter((r[1] or "", r[2] or "", w) for r in rows for w in brute_terms(r[0]))
    got = Counter()
    for t, d, n in zip(block.term.tolist(), block.doc.tolist(), block.count.tolist()):
        group = block.of_doc[d]
        got[block.langs[group], block.sources[group], words[t][:-1].decode()] += n
    assert got == want
    some = np.arange(block.starts.size)
    for width in (1, 2, 5):
        assert block.prefixes(some, width).to_pylist() == [w[:width] for w in words]
        number, first = block.prefix_groups(width)
        assert [w[:width] for w in words] == [words[first[k]][:width] for k in number]


def brute_terms(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def test_source_audit_of_nothing(spark):
    assert source_audit.audit(spark.createDataFrame([], AUDIT)).collect() == []


def test_prefixes_are_counted_by_document(spark):
    """A document with several terms of one prefix counts once at that prefix's level."""
    rows = [("abc abd abe abc", "en", "s"), ("abd x", "en", "s"), ("y", "en", "s")]
    blocks = source_audit.stage(spark.createDataFrame(rows, "text string, lang string, source string"),
                                "text", "lang", "source")
    got = {bytes(r["prefix"]): r["df"] for r in source_audit.level(blocks, 2, None).collect()}
    assert got == {b"ab": 2, b"x\0": 1, b"y\0": 1}


def test_shares_are_exact():
    import numpy as np

    for count, total in ((0, 5), (10**15, 10**15 + 5), (123456789012345, 9 * 10**14 + 7)):
        want = 1 + 10**9 * (count + 5) // total
        assert source_audit.shares(np.array([count]), np.array([total]))[0] == want


# --- token alignment -----------------------------------------------------------------


def alignment_texts():
    more = ["<s> a </s> <unk> <|endoftext|> b", " lead  and   trail  ", "\n\n", " ", "  ", "\nx", "x\n", "a ▁ b", "ﬁ é 日本語 🙂",
            "tab\tand nbsp 　 x\r\n", "\x00 \x1c y", "aaaa" * 500, "don't stop,won't 12345 €5"]
    return texts() + [(1000 + k, t) for k, t in enumerate(more)]


@pytest.fixture(scope="module")
def aligned():
    import sentencepiece

    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    table = tokens.byte_level_table()
    a_bytes = {k: bytes(table[c] for c in t) for t, k in library.get_vocab().items() if t != "<|endoftext|>"}
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def b(text):
        named = [(k, pieces.id_to_piece(k)) for k in pieces.encode(text)]
        return [(k, bytes([int(p[3:-1], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode())
                for k, p in named]

    return brute.align(alignment_texts(), lambda t: library.encode(t, add_special_tokens=False).ids, a_bytes, b)


def test_token_alignment(spark, none, aligned, monkeypatch):
    docs = spark.createDataFrame([(*d, 1, 2) for d in alignment_texts()], SCHEMA + ", pair long, block long").repartition(4)
    got = token_alignment.align(docs, BPE, PIECES)
    same(got, [r[:-1] for r in aligned])
    assert sum(r[4] > r[5] for r in aligned) > 20  # links that are not the most frequent ones
    assert token_alignment.align(none, BPE, PIECES).collect() == []


def test_groups_as_text(spark, aligned):
    got = token_alignment.groups(spark.createDataFrame(alignment_texts(), SCHEMA), BPE, PIECES)
    same(got, [(r[0], r[-1]) for r in aligned])


def test_pair_counts(spark, aligned):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the cat the cat"), (3, "cat")], SCHEMA)
    blocks = token_alignment.stage(docs, BPE, PIECES, "doc_id", "text")
    rows = token_alignment.pair_counts(blocks, 32_000).collect()
    assert sorted(r["docs"] for r in rows) == [2, 3] and all(r["best"] for r in rows)


def test_parts_are_found_again(monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 8)
    own = token_alignment.aligner(BPE, PIECES)
    words = [f" w{k % 13}x" for k in range(60)]
    once = {w: own.find([w]) for w in sorted(set(words))}
    for at in range(0, 60, 5):
        figures, pairs, text = own.find(words[at:at + 5])
        first = 0
        for k, w in enumerate(words[at:at + 5]):
            last = first + figures[k, 3]
            assert text[k] == once[w][2][0] and figures[k].tolist() == once[w][0][0].tolist()
            assert pairs[first:last].tolist() == once[w][1].tolist()
            first = last
    assert len(own.new.text) < 20


# --- exact duplicates ----------------------------------------------------------------


def copies():
    spread = [(3000 + k, f"same  text\t{k % 3}") for k in range(30)]
    near = [(4000, "p" * 64 + "a"), (4001, "p" * 64 + "b"), (4002, "p" * 64 + "a"), (4003, "é" * 40)]
    return texts() + spread + near + [(None, "same text 0"), (None, "lonely null"), (None, "two nulls"), (None, "two  nulls")]


@pytest.mark.parametrize("bits", [exact_dedup.BITS, 1])
def test_exact_duplicates(spark, none, bits):
    docs = spark.createDataFrame(copies(), SCHEMA).repartition(4)
    got = exact_dedup.exact_duplicates(docs, digest=True, bits=bits)
    same(got.select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))), brute.exact(copies()))
    assert exact_dedup.exact_duplicates(none).collect() == []


def test_only_shared_prefixes_are_read_in_full(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "abcd"), (4, "x" * 70 + "y"), (5, "x" * 70 + "z")], SCHEMA)
    rows = exact_dedup._marked(exact_dedup._measured(docs, "doc_id", "text"), exact_dedup.BITS).collect()
    assert {r["id"] for r in rows if r["alive"]} == {4, 5}


def test_heavy_and_light_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY", 4)
    rows = [(k, "hot") for k in range(40)] + [(100 + k, f"pair {k // 2}") for k in range(20)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA), digest=True)
    same(got.select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))), brute.exact(rows))


def test_keep_one_of_equal_texts(spark, none):
    docs = spark.createDataFrame(copies(), SCHEMA).select(
        "doc_id", "text", F.lit(1).alias("length"), F.lit("p").alias("prefix"), F.lit(2).alias("full"))
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in brute.exact(copies()) if r[3])
    assert exact_dedup.keep_one(none).collect() == []


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
