"""Each operator against its plain version, with nulls, empty and long texts, ties and
repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from touchline.llm import (
    bwt_dedup, byte_bpe, imatch, license_scan, packing, quote_linking, simhash, substring_dedup,
    suffix_quality, token_files, tokens)
from touchline.llm.exchange import press, unpress
from touchline.llm.shared import Chunk, Spans, mix

SCHEMA = "doc_id long, text string"
BPE, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def texts():
    """Documents with everything that has a defined result."""
    draw = random.Random(7)
    vocabulary = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 5))) for _ in range(60)]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage, line = prose(60), prose(14)
    docs = []
    for k in range(40):
        body = prose(draw.randint(1, 90))
        if k % 4 == 0:
            body += " " + passage + " " + prose(5)
        if k % 5 == 0:
            body = line + "\n" + body + "\n" + line + "\n" + line
        docs.append((100 + 3 * k, body))
    copy = docs[7][1]
    docs += [(20, copy), (21, copy.replace(" ", "\n", 3)), (22, copy + " end"), (23, copy), (23, copy)]
    docs += [(None, copy), (None, passage), (5, None), (6, ""), (7, " \n\t "), (8, "a"), (8, None)]
    docs += [(9, "na " * 300), (10, "xy" * 400), (11, "xy" * 300 + prose(30)), (12, "ab cd " * 150)]
    docs += [(13, prose(3000) + " " + passage), (14, "#*$ | <b> & 100%\n" * 40), (15, "It's <|endoftext|> ok é 　x\t\ty  z\r\n")]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(frame, want):
    assert Counter(tuple(r) for r in frame.collect()) == Counter(want)


def sha(column):
    return F.sha2(F.col(column).cast("binary"), 256)


def test_substring_dedup(docs, none):
    got = substring_dedup.remove_repeats(docs).select("id", "n_words", "n_removed", sha("kept"))
    want = brute.substring_dedup(texts())
    same(got, want)
    assert sum(w[2] for w in want) > 300
    assert substring_dedup.remove_repeats(none).collect() == []


def test_wide_symbols_carry_long_repeats(spark):
    """Two texts share 3,000 words between others: most of them lie in shared wide symbols,
    and the second text tells of few of its windows one by one."""
    import pyarrow as pa

    draw = random.Random(6)
    words = [f"w{k}" for k in range(500)]
    passage = draw.choices(words, k=3000)
    one, two = (" ".join(draw.choices(words, k=200) + passage + draw.choices(words, k=200)) for _ in range(2))
    names = [substring_dedup.Names(Chunk(pa.record_batch(
        {"id": pa.array([k], pa.int64()), "text": pa.array([t])})), 13, 16) for k, t in enumerate((one, two))]
    same_ = np.isin(names[1].symbol, names[0].symbol)
    begin, end = names[1].begin[same_], names[1].end[same_]
    assert (end - begin).max() > 300
    told = 3400 - 12 - sum(np.bincount(np.unique(np.concatenate([np.arange(a, b - 12) for a, b in zip(begin, end)]))))
    assert told < 600
    got = substring_dedup.remove_repeats(spark.createDataFrame([(0, one), (1, two)], SCHEMA))
    assert {r["id"]: r["n_removed"] for r in got.select("id", "n_removed").collect()} == {0: 0, 1: 3000}


def test_substring_dedup_without_shared_symbols(spark):
    """A chunk may share no wide symbol with any other: it has none to tell of."""
    empty = press(np.zeros(0, "<u8"), np.zeros(0, "<i4"))
    assert [(x.size, x.dtype.str) for x in unpress(empty, "<u8", "<i4")] == [(0, "<u8"), (0, "<i4")]
    rows = [(k, " ".join(f"w{k}x{n}" for n in range(40))) for k in range(3)] + [(9, "few words"), (10, None)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).select("id", "n_words", "n_removed")
    same(got, [(0, 40, 0), (1, 40, 0), (2, 40, 0), (9, 2, 0), (10, 0, 0)])


def test_substring_dedup_over_many_chunks(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 1000)
    got = substring_dedup.remove_repeats(docs.repartition(8)).select("id", "n_words", "n_removed", sha("kept"))
    same(got, brute.substring_dedup(texts()))


@pytest.mark.parametrize("hot", [512, 1])
def test_bwt_dedup(docs, none, hot):
    got = bwt_dedup.remove_repeats(docs.repartition(6), hot=hot).select(
        "id", "n_bytes", "n_removed", F.size("removed").cast("long"), sha("kept"))
    same(got, brute.bytes_dedup(texts()))
    if hot > 1:
        assert bwt_dedup.remove_repeats(none).collect() == []


def long_texts():
    draw = random.Random(1)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(30_000)]
    return {"prose": " ".join(draw.choices(vocabulary, k=800_000)), "periodic": "na " * 1_700_000}


@pytest.mark.parametrize("kind, most", [("prose", 45), ("periodic", 90)])
def test_very_long_texts_in_one_task(kind, most):
    """Five megabytes in one text: seconds, and so many bytes of memory for each of its own."""
    import time
    import tracemalloc

    import pyarrow as pa

    text = long_texts()[kind]
    block = pa.record_batch({"id": pa.array([1], pa.int64()), "text": pa.array([text])})

    def bytes_task():
        chunk = Chunk(block)
        found = bwt_dedup.Anchors(chunk, 100)
        bwt_dedup.repeats_inside(found, chunk, 100)
        bwt_dedup.Entries(chunk, found, np.arange(found.key.size), 100)

    def words_task():
        chunk = Chunk(block)
        names = substring_dedup.Names(chunk, 13, 16)
        substring_dedup.named(names.words, names.at, chunk.ids[names.doc], 13)

    for task in (bytes_task, words_task, lambda: suffix_quality.measure(block, 10)):
        tracemalloc.start()
        began = time.time()
        task()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert time.time() - began < 60 and peak < most * len(text)


def test_very_long_texts(spark):
    """Through Spark, next to short ones, for the operators that look inside a text."""
    both = long_texts()
    rows = [(1, both["prose"]), (2, both["periodic"]), (3, "short " * 60), (4, both["prose"][:300] + " tail"),
            (5, both["periodic"][:120_000])]
    docs = spark.createDataFrame(rows, SCHEMA)
    removed = {r["id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).select("id", "n_removed").collect()}
    assert removed[1] == removed[2] == 0 and removed[4] > 30 and removed[5] == 40_000
    gone = {r["id"]: (r["n_bytes"], r["n_removed"]) for r in bwt_dedup.remove_repeats(docs).select(
        "id", "n_bytes", "n_removed").collect()}
    assert gone[2] == (5_100_000, 5_099_997) and gone[5] == (120_000, 120_000) and gone[4][1] >= 299
    judged = {r["id"]: (r["n_words"], r["longest_repeat"]) for r in suffix_quality.quality(docs).collect()}
    assert judged[2] == (1_700_000, 1_699_999) and judged[1][0] == 800_000
    notice = license_scan.TEMPLATES[3][1]
    long_ = spark.createDataFrame([(1, both["prose"] + " " + notice + " " + both["prose"])], SCHEMA)
    assert license_scan.scan(long_).first()["labels"] == "gpl-3"


def test_common_line_is_spread(spark, monkeypatch):
    """A line in every document: its strings go to many buckets, none to one alone."""
    monkeypatch.setattr(bwt_dedup, "BUCKET_BYTES", 20_000)
    draw = random.Random(8)
    line = "".join(draw.choice("abcdefgh ") for _ in range(300))
    rows = [(k, "".join(draw.choice("ijklmnop ") for _ in range(200)) + line) for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(12)
    got = bwt_dedup.remove_repeats(docs, hot=3)
    same(got.select("id", "n_bytes", "n_removed", F.size("removed").cast("long"), sha("kept")), brute.bytes_dedup(rows))
    import pyarrow as pa

    chunk = Chunk(pa.record_batch({"id": pa.array([1], pa.int64()), "text": pa.array([rows[0][1]])}))
    found = bwt_dedup.Anchors(chunk, 100)
    strings = bwt_dedup.Strings(found, np.arange(found.key.size), 100)
    entries = bwt_dedup.Entries(chunk, strings, np.arange(strings.at.size), 100)
    assert len(list(entries.buckets(16))) > 12


def test_quality(docs, none):
    got = suffix_quality.quality(docs)
    same(got, [(d, *brute.quality(t)) for d, t in texts()])
    assert suffix_quality.quality(none).collect() == []


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component")
    same(got, brute.components(texts()))
    assert simhash.near_duplicates(none).collect() == []


def test_simhash_tiles_find_every_link():
    draw = np.random.default_rng(3)
    seeds = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(1) << draw.integers(0, 64, 600, dtype=np.uint64) for _ in range(3)]
    fps = np.unique(np.concatenate([seeds, seeds[draw.integers(0, 40, 600)] ^ flips[0] ^ flips[1] ^ flips[2]]))
    order = np.lexsort((fps, np.bitwise_count(fps)))
    fps = fps[order]
    a, b = fps[:300], fps[300:]
    found = np.concatenate([simhash.forest(x, y, 4, x is y, 16) for x, y in ((a, a), (a, b), (b, b))])

    def classes(pairs):
        up = {f: f for f in fps.tolist()}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for u, v in pairs:
            up[root(u)] = root(v)
        groups = defaultdict(set)
        for f in up:
            groups[root(f)].add(f)
        return sorted(map(sorted, groups.values()))

    every = [(u, v) for i, u in enumerate(fps.tolist()) for v in fps.tolist()[:i] if (u ^ v).bit_count() <= 4]
    assert classes(found.tolist()) == classes(every)
    assert len(found) < 3 * fps.size < len(every) * 3


@pytest.mark.parametrize("sides, side, heavy", [(3, 256, 1000), (1, 1, 2)])
def test_simhash_over_many_blocks(docs, monkeypatch, sides, side, heavy):
    for name, value in (("BLOCK", 4), ("SIDES", sides), ("SIDE", side), ("HEAVY", heavy)):
        monkeypatch.setattr(simhash, name, value)
    got = simhash.near_duplicates(docs).select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component")
    same(got, brute.components(texts()))


def test_components_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = simhash.components(spark.createDataFrame(chain, "u long, v long"))
    same(got, [(k, 0) for k in range(61)] + [(100, 100), (101, 100)])


def test_keep_one_keeps_columns_and_clean_documents(spark, docs):
    named = docs.select("doc_id", "text", F.lit(1).alias("id"), F.lit("x").alias("rest"), F.lit(2).alias("fp"),
                        F.lit(3).alias("component"))
    kept = simhash.keep_one(named)
    assert kept.columns == named.columns
    least = {(c, None if c is not None else f) for _, f, c in brute.components(texts())}
    assert kept.count() == len(least)
    assert {r["doc_id"] for r in kept.collect()} == {c for c, _ in least}


def test_keep_one_keeps_a_document_of_each_group(spark):
    draw = random.Random(11)
    prose = lambda: " ".join("".join(draw.choices("abcde", k=5)) for _ in range(200))

    def near(text):
        """A text whose fingerprint differs by a few bits."""
        return next(t for t in (f"{text} {k}" for k in range(10_000))
                    if 0 < (brute.simhash(t) ^ brute.simhash(text)).bit_count() <= simhash.RADIUS)

    a, b, c, d, e = (prose() for _ in range(5))
    groups = [[(5, a), (7, near(a))], [(5, b), (9, near(b)), (None, b)],  # one id, two groups
              [(None, c), (None, near(c)), (None, c)], [(None, d)],  # null ids only
              [(3, e), (3, near(e)), (3, e), (4, e)]]  # one id twice in its group
    kept = simhash.keep_one(spark.createDataFrame([r for g in groups for r in g], SCHEMA)).collect()
    got = Counter(next(n for n, g in enumerate(groups) if tuple(r) in g) for r in kept)
    assert got == Counter(range(len(groups)))
    assert Counter(r["doc_id"] for r in kept) == Counter([5, 5, None, None, 3])


def token_rows(frame):
    return Counter((r["id"], r["n_tokens"], r["ids_crc32"]) for r in frame.collect())


def test_token_file(docs, none):
    own = Tokenizer.from_file(WORDS)
    want = Counter()
    for doc, text in texts():
        ids = own.encode(text or "", add_special_tokens=False).ids + [1]
        want[doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    rows = token_files.token_file(docs, WORDS)
    assert token_rows(rows) == want
    in_file = sorted(rows.collect(), key=lambda r: r["start"])
    at = 0
    for row in in_file:
        assert row["start"] == at
        at += row["n_tokens"]
    ids = [r["id"] for r in in_file]
    assert ids == sorted(ids, key=lambda d: (d is None, d))
    assert token_files.token_file(none, WORDS).collect() == []


def test_forgotten_parts_are_encoded_again(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 40)
    monkeypatch.setattr(tokens, "KEEP", 15)
    own = tokens.tokenizer(WORDS)
    encoder = tokens.Encoder(tokens._by_words(own), False)
    plain = [text or "" for _, text in texts()]
    for _ in range(2):
        for at in range(0, len(plain), 3):
            some = plain[at:at + 3]
            ids, bounds = tokens.encode_with(encoder, some)
            want = [own.encode(t, add_special_tokens=False).ids for t in some]
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    often, seldom = ["and"] * 5, [f"word{k}" for k in range(50)]
    encoder.forget()
    for word in seldom:
        encoder.numbers([*often, word])
    encoder.forget()
    assert "and" in encoder and len(encoder) == 15


def test_any_token_is_read_without_the_others():
    draw = np.random.default_rng(5)
    ids = np.where(draw.random(5000) < 0.7, draw.integers(0, 40, 5000), draw.integers(0, 1 << 20, 5000)).astype(np.uint32)
    data = token_files.write_segment(ids, np.array([0, 2000, 5000]), np.array([4, 9]), np.array([False, True]))
    segment = token_files.Segment(data)
    places = draw.integers(0, 5000, 700)
    assert (segment.ids_at(places) == ids[places]).all()
    assert all(segment.ids_at(np.array([p]))[0] == ids[p] for p in places[:40])
    assert (segment.document(1) == ids[2000:]).all()
    assert len(segment.levels) > 1
    for one in (np.zeros(0, np.uint32), np.zeros(3, np.uint32), np.array([2**32 - 1], np.uint32)):
        made = token_files.Segment(token_files.write_segment(one, np.array([0, one.size]), np.array([1]), np.array([False])))
        assert (made.document(0) == one).all()


def test_byte_bpe_is_as_the_library(docs, none):
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks={t: k for k, t in enumerate(ranks)})
    want = []
    for doc, text in texts():
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want.append((doc, ids.size, brute.sha(ids.tobytes()), brute.sha(text or "")))
    got = byte_bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN)
    same(got.select("id", "n_tokens", sha("ids"), sha("decoded")), want)
    assert byte_bpe.encode_decode(none, ranks, public_tokenizers.PATTERN).collect() == []


def test_perfect_hash_is_minimal():
    keys = [f"key{k}".encode() for k in range(3000)]
    made = byte_bpe.PerfectHash(keys)
    assert sorted(made.slot(k) for k in keys) == list(range(3000))
    assert all(made.key_at[made.slot(k)] == i for i, k in enumerate(keys))


def test_imatch(spark, docs, none):
    rows = imatch.edited_likeness(docs, low=0.05, high=0.5).collect()
    order = sorted(texts(), key=lambda d: (d[0] is None, d[0]))
    whole = [(d, t or "") for d, t in order]
    assert Counter((r["id"], r["n_chars"]) for r in rows) == Counter((d, len(t)) for d, t in whole)
    once = [d for d, n in Counter(d for d, _ in whole).items() if n == 1 and d is not None]
    at = {d: k for k, (d, _) in enumerate(whole)}
    found = {r["id"]: r for r in rows}
    for doc in once:
        following = whole[(at[doc] + 1) % len(whole)]
        if following[0] in once:
            text = whole[at[doc]][1]
            size = len(text) // 4
            assert found[doc]["edited_sha256"] == brute.sha(text[:len(text) - size] + following[1][:size])
    by_text = defaultdict(set)
    texts_of = defaultdict(set)
    for d, t in whole:
        texts_of[d].add(t)
    for r in rows:
        if len(texts_of[r["id"]]) == 1:
            by_text[next(iter(texts_of[r["id"]]))].add(r["own"])
    assert all(len(x) == 1 for x in by_text.values())
    assert imatch.edited_likeness(none).collect() == []
    one = spark.createDataFrame([(1, "abcdefgh one two")], SCHEMA)
    assert imatch.edited_likeness(one).first()["edited_sha256"] == brute.sha("abcdefgh one" + "abcd")


def test_imatch_is_as_its_plain_version(spark):
    docs = [(k, t) for k, (d, t) in enumerate(texts()) if len(t or "") < 3000]  # ids that are all different
    hash_of = lambda w: int(Spans(np.frombuffer(w, np.uint8)).of(np.array([0]), np.array([len(w)]))[0])
    mixed = lambda x, seed: int(mix(np.array([x], np.uint64), seed)[0])
    want = brute.imatch(docs, 0.05, 0.5, imatch.HASHES, imatch.RATES, imatch.PER_RATE, hash_of, mixed)
    got = imatch.edited_likeness(spark.createDataFrame(docs, SCHEMA).repartition(5), low=0.05, high=0.5).collect()
    found = {r["id"]: (np.frombuffer(r["own"], "<u4").tolist(), np.frombuffer(r["edited"], "<u4").tolist(),
                       r["near_edited"], r["near_next"]) for r in got}
    assert found == {d: tuple(rest) for d, *rest in want}
    assert any(0 < w[3] < 1 for w in want) and any(w[4] > 0 for w in want)


def test_terms_of_many_documents():
    import pyarrow as pa

    doc, term = imatch.terms(pa.array([f"w{k % 7}" for k in range(70_000)]))
    assert doc.tolist() == list(range(70_000)) and len(set(term.tolist())) == 7


def test_a_lexicon_beyond_its_bound_is_an_error(docs, monkeypatch):
    monkeypatch.setattr(imatch, "MOST_TERMS", 3)
    with pytest.raises(ValueError, match="low"):
        imatch.edited_likeness(docs, low=0.01, high=0.9)


def test_lexicon_counts_all_documents(docs):
    n = len(texts())
    df = Counter()
    for _, text in texts():
        df.update({w for w in "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " "
                                      for c in text or "").split(" ") if w})
    want = sum(0.05 * n <= k <= 0.5 * n for k in df.values())
    assert imatch.lexicon(docs, low=0.05, high=0.5).count() == want


def test_packing(docs, none):
    own = Tokenizer.from_file(BPE)
    for capacity in (2048, 64):
        rows = packing.pack(docs, BPE, capacity=capacity).collect()
        want = brute.token_pieces(texts(), own, capacity)
        assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter(want)
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(bins) <= packing.lower_bound(Counter(r["length"] for r in rows), capacity) + 1
    assert packing.pack(none, BPE).collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_finds_the_fewest(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(8, 60) for _ in range(11)]
    plan = packing.complete(Counter(lengths), 100)
    used = Counter()
    for filling, times in plan:
        assert sum(filling) <= 100
        for n in filling:
            used[n] += times
    assert used == Counter(lengths)
    assert sum(t for _, t in plan) == brute.best_packing(lengths, 100)


def test_search_beats_best_fit():
    better = 0
    for seed in range(300):
        draw = random.Random(seed)
        capacity = draw.choice([30, 60, 100])
        lengths = Counter(draw.randint(max(1, capacity // 8), capacity * 6 // 10) for _ in range(draw.randint(5, 12)))
        fewest = brute.best_packing(list(lengths.elements()), capacity)
        assert sum(t for _, t in packing.complete(lengths, capacity)) == fewest
        better += sum(t for _, t in packing.best_fit(lengths, capacity)) > fewest
    assert better > 5
    assert packing.complete(Counter([4, 4, 3, 3, 3, 3]), 10) == [((4, 3, 3), 2)]
    assert len(packing.best_fit(Counter([4, 4, 3, 3, 3, 3]), 10)) == 3


def test_fillings_are_the_undominated_ones():
    draw = random.Random(4)
    for _ in range(60):
        room = draw.randint(5, 30)
        counts = Counter(draw.randint(1, 12) for _ in range(draw.randint(1, 7)))
        subsets = {()}
        for n in counts.elements():
            subsets |= {tuple(sorted((*s, n), reverse=True)) for s in subsets}
        want = set()
        for s in subsets:
            spare = room - sum(s)
            left = counts - Counter(s)
            grows = any(n <= spare for n in left)
            swaps = any(a < n <= a + spare for a in s for n in left)
            joins = any(s[i] + s[j] <= n <= s[i] + s[j] + spare for i in range(len(s)) for j in range(i) for n in left)
            if spare >= 0 and not (grows or swaps or joins):
                want.add(s)
        got = [f for _, f in packing.fillings(counts, room, room, [10**6])]
        assert len(got) == len(set(got)) and want <= set(got)
        # A filling that could grow is fuller in another place of the list.
        assert all(any(n <= room - sum(f) for n in counts - Counter(f)) for f in set(got) - want)


def test_encoders_are_as_the_library():
    draw = random.Random(9)
    pieces = ["a", "Z", " ", "  ", "\n", "\t", "é", "É", "ß", "İ", "ſ", "²", "½", "µ", "Œ", "'s", "'LL", "don't", "’", "“", "…", "€", "—",
              "\u00a0", "\u3000", "\x1c", "\x85", "日本", "🙂", "1", "23", ".", ",", "<|endoftext|>", "<|startoftext|>", "word"]
    some = ["".join(draw.choices(pieces, k=draw.randint(0, 25))) for _ in range(1500)]
    some += [f"A{chr(c)} b{chr(c)}1 {chr(c)}x" for c in range(0x2100) if not 0xD800 <= c < 0xE000]
    some += [" " * 5000, "a" * 5000, "é " * 3000, "end <|endoftext|> start"]
    for path, spaces in ((WORDS, False), (BPE, True)):
        for plain in (False, True):
            library = tokens.tokenizer(path, plain)
            own = tokens.encoder(path, spaces, plain)
            for at in range(0, len(some), 300):
                ids, bounds = tokens.encode_with(own, some[at:at + 300])
                want = [library.encode(t, add_special_tokens=False).ids for t in some[at:at + 300]]
                assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert Tokenizer.from_file(WORDS).encode(some[-1], add_special_tokens=False).ids == [806, 49407, 1572]


FALSE_NOTICES = ["released under the Sony license in 1999",
                 "the license of the band was released in may and the rest came under fire",
                 "Licensed under the Mozilla Public License, Version 2.0"]


def test_license_labels_need_their_telling_words(spark):
    rows = list(enumerate(FALSE_NOTICES))
    rows += [(10, "Licensed under a Creative Commons Attribution 4.0 International License."),
             (11, "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
             (12, "This work is licensed under the GNU General Public License, version 3."),
             (13, "licensed under the gnu affero general public license version 3"),
             (14, FALSE_NOTICES[0] + "\n" + "x " * 400 + "licensed under the gnu lesser general public license")]
    rows += [(100 + k, text) for k, (_, text) in enumerate(license_scan.TEMPLATES)]
    rows += [(200 + k, (text + " ") * 3) for k, (_, text) in enumerate(license_scan.TEMPLATES)]
    got = {r["id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k] for k in range(3)] == ["", "", ""]
    assert [got[k] for k in range(10, 15)] == ["cc-by", "cc-by-sa", "gpl-3", "agpl-3", "lgpl"]
    for k, (label, _) in enumerate(license_scan.TEMPLATES):
        assert got[100 + k] == got[200 + k] == label


def test_license_scan(spark, none):
    rows = [(1, "Released under the MIT License."), (2, "under the  mit-license and CC by NC, cc BY nc"), (3, None), (4, ""),
            (None, "Apache License Version 2"), (5, "This work is licensed under the GNU General Public License, version 3."),
            (6, "this work is licensed under the general gnu\npublic"), (6, "no license"), (6, "no license"),
            (7, "x " * 5000 + "under the mit license"), (8, "under the mit\nlicense under the mit license")]
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["id"], []).append(tuple(r)[1:])
    assert got[1] == [(5, 1, 1, 1, "mit", "mit", 1.0)]
    assert got[2] == [(11, 3, 0, 8, "cc-by-nc,mit", "cc-by-nc,mit", 1.0)]
    assert got[3] == got[4] == [(0, 0, None, None, "", "", 0.0)]
    assert got[None][0][5] == "apache-2" and got[5] == [(12, 0, None, None, "", "gpl-3", 1.0)]
    assert sorted(x[:2] for x in got[6]) == [(2, 0), (2, 0), (9, 0)]
    assert got[7][0][:4] == (5004, 1, 5000, 5000) and got[8][0][:4] == (8, 2, 0, 4)
    assert license_scan.scan(none).collect() == []


def test_base_phrases_are_those_of_the_contract(spark):
    rows = [(1, "The MIT License (MIT)"), (2, "Under-the\nMIT License, the MIT license"), (3, "under the mit licenses"),
            (4, "apache license, version 2 CC-BY-NC under the mit license"), (5, "éunder the mit license")]
    got = license_scan.scan(spark.createDataFrame(rows, SCHEMA)).select(
        "id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    same(got, [(1, 4, 0, None, None, ""), (2, 7, 1, 0, 0, "mit"), (3, 4, 0, None, None, ""),
               (4, 11, 3, 0, 7, "apache-2,cc-by-nc,mit"), (5, 4, 0, None, None, "")])


def test_license_join_is_exact(spark):
    draw = random.Random(2)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()})
    lines = []
    for k in range(300):
        label, text = draw.choice(license_scan.TEMPLATES)
        some = [w for w in text.split() if draw.random() < 0.85] + draw.sample(vocabulary, draw.randint(0, 6))
        draw.shuffle(some)
        lines.append((k, " ".join(some)))
    got = {(r["id"], r["template"]) for r in license_scan.license_blocks(spark.createDataFrame(lines, SCHEMA)).collect()}
    want = {(k, n) for k, line in lines for n, (_, t) in enumerate(license_scan.TEMPLATES)
            if len(set(line.split()) & set(t.split())) >= 0.8 * len(set(t.split())) - 1e-9}
    assert got == want and want


WRAPPED = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a\n"
            "copy of this software and associated documentation files (the \"Software\")", 1.0),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted", 1.0),
    ("gpl-2", " * This program is free software; you can redistribute it and/or modify\n"
              " * it under the terms of the GNU General Public License as published by\n"
              " * the Free Software Foundation; either version 2 of the License, or", 20 / 22),
    ("cc0", "To the extent possible under law, the author has waived all copyright\r\nand related rights", 1.0)]


@pytest.mark.parametrize("around", ["{}", "some words first\n\n{}\nand 300 more\n" + "word\n" * 300])
def test_wrapped_notices_are_found(spark, around):
    rows = [(k, around.format(text)) for k, (_, text, _) in enumerate(WRAPPED)]
    rows += [(None, rows[0][1]), (0, rows[0][1]),
             # The words of a template far apart are no notice.
             (9, "\n".join(w + "\nx y z" for w in license_scan.TEMPLATES[1][1].split()))]
    got = Counter((r["id"], r["labels"], round(r["score"], 9))
                  for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect())
    want = [(k, label, round(score, 9)) for k, (label, _, score) in enumerate(WRAPPED)]
    assert got == Counter([*want, (None, "mit", 1.0), want[0], (9, "", 0.0)])


def test_license_windows_are_exact(spark):
    draw = random.Random(3)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()})
    docs = []
    for k in range(150):
        some = []
        for _ in range(3):
            some += [w for w in draw.choice(license_scan.TEMPLATES)[1].split() if draw.random() < 0.9]
            some += draw.choices(vocabulary + ["x"] * 60, k=draw.randint(0, 12))
        docs.append((k, " ".join(w + "\n" * (draw.random() < 0.2) for w in some)))
    want = {}
    for k, text in docs:
        words = text.split()
        for n, (_, template) in enumerate(license_scan.TEMPLATES):
            own, reach = set(template.split()), int(len(template.split()) / 0.8 + 1e-9)
            best = max(len(own & set(words[i:i + reach])) for i in range(len(words)))
            if best >= 0.8 * len(own) - 1e-9:
                want[k, n] = best / len(own)
    rows = license_scan.license_windows(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {(r["id"], r["template"]): r["containment"] for r in rows} == want and len(rows) == len(want) > 300


CHAT = "conv_id long, turn long, role string, text string"


def test_repeated_messages_count_once(spark):
    rows = [(1, 0, "user", "One line"), (1, 1, "bot", "> one line\nyes"), (1, 1, "bot", "> one line\nyes"),
            (1, 2, "bot", "> one line\n> One  line\nthrice\n> one line")]
    got = quote_linking.link(spark.createDataFrame(rows, CHAT))
    same(got.select("turn", "n_quotes", "n_linked", "reply_to"),
         [(0, 0, 0, None), (1, 1, 1, 0), (1, 1, 1, 0), (2, 3, 3, 0)])


def test_writers_come_before_or_from_elsewhere(spark):
    rows = [(1, 0, "user", "> said later\nfirst"), (1, 1, "bot", "said later"),  # a later message
            (2, 0, "user", "> my own words\nmy own words"),  # its own text
            (3, 0, "user", "> elsewhere\nx"), (4, 5, "user", "elsewhere"),  # another conversation
            (5, 0, "user", "common"), (6, 0, "user", "common"), (5, 1, "bot", "> common\ny"), (None, 1, "bot", "> common\nz"),
            (None, 2, "bot", "lost words"), (7, 1, "bot", "> lost words\nq")]
    got = quote_linking.link(spark.createDataFrame(rows, CHAT))
    assert {(r["conv_id"], r["turn"]): (r["n_quotes"], r["n_linked"], r["reply_to"]) for r in got.collect() if r["n_quotes"]} == {
        (1, 0): (1, 0, None), (2, 0): (1, 0, None), (3, 0): (1, 1, None), (5, 1): (1, 1, 0), (None, 1): (1, 1, None),
        (7, 1): (1, 0, None)}


def test_quotes_are_linked(spark):
    rows = [(1, 0, "user", "Hello there\nHow are  you?"), (1, 1, "assistant", "> how are you?\nFine."),
            (1, 2, "user", "> > How are you?\n> Fine.\nGood"), (1, 3, "user", ">> never said\n> other text\nx"),
            (2, 0, "user", "> Fine.\nelsewhere"), (2, 1, "user", None), (None, None, None, "> Good"), (2, 1, "user", None)]
    got = quote_linking.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = [(1, 0, "Hello there\nHow are  you?", 0, 0, None, 0, 0), (1, 1, "Fine.", 1, 1, 0, 0, 1),
            (1, 2, "Good", 2, 2, 1, 0, 2), (1, 3, "x", 2, 0, None, 3, 0), (2, 0, "elsewhere", 1, 1, None, 0, 0),
            (2, 1, "", 0, 0, None, 1, 0), (2, 1, "", 0, 0, None, 1, 0), (None, None, "", 1, 1, None, None, 0)]
    same(got.select("conv_id", "turn", "text", "n_quotes", "n_linked", "reply_to", "thread", "depth"), want)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quote_linking.link(empty).collect() == []
