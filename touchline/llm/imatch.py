"""I-Match document fingerprints with randomised lexicon subsets.

A document's terms are its distinct lower-cased words. Terms whose document frequency is
between ``low`` and ``high`` of all documents (an inverse-document-frequency band) form the
lexicon. Each lexicon subset keeps a term by a random value of it: one subset is the whole
lexicon, the others keep a quarter, a sixteenth, ... of it, several at each rate, so short
and long documents alike have subsets that a local edit leaves alone. Per subset a
document's kept terms, distinct and sorted, are hashed; a fingerprint is the row of these
hashes, zero where no term was kept. A document without any lexicon term takes all its
terms as the whole.

A term in the band is in at least ``low`` of the documents, so there are at most (mean
distinct terms per document) / ``low`` of them: the lexicon has a bound that does not grow
with the corpus, and is broadcast. The bound is held: beyond ``MOST_TERMS`` it is an error. Document frequencies are counted over all documents.

Defined results: a null or empty text has no terms and the fingerprint of nothing; null ids
come last in the order; rows with one id are ordered by a hash of their text; the only
document of a table is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import (
    Spans, blob, by_bucket, internal, materialize, mix, owner, slices, text_bytes, word_bounds)

LOW, HIGH = 0.001, 0.2
#: Subsets keep one in 4, 16, ... terms; so many at each rate, besides the whole lexicon.
RATES, PER_RATE = 5, 16
HASHES = 1 + RATES * PER_RATE
#: Documents and text bytes that are worked on together.
BLOCK, ROWS = 1 << 20, 20_000
#: Documents that a number of 16 bits can tell apart.
NUMBERS = 1 << 16
#: Text bytes per bucket of terms when document frequencies are counted.
BUCKET_BYTES = 8 << 20
#: Terms of the lexicon that are sent to all tasks at most (64 MB); see ``edited_likeness``.
MOST_TERMS = 8 << 20

_TERM = np.ones(256, bool)
_TERM[:128] = False
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BITS = np.uint64((1 << 48) - 1)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, term) sorted, terms as 48-bit hashes."""
    if len(texts) > NUMBERS:
        parts = [terms(texts.slice(at, NUMBERS)) for at in range(0, len(texts), NUMBERS)]
        return (np.concatenate([doc + k * NUMBERS for k, (doc, _) in enumerate(parts)]),
                np.concatenate([term for _, term in parts]))
    data, starts = text_bytes(texts)
    data = np.where(_TERM[data], _LOWER[data], np.uint8(32)).astype(np.uint8)
    begin, end, bounds = word_bounds(data, starts)
    if not begin.size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = Spans(data).of(begin, end) & _BITS
    key = owner(bounds).astype(np.uint64) << np.uint64(48) | hashes
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(48)).astype(np.int64), key & _BITS


def fold(doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """Per document a 32-bit hash of its terms in order; zero if it has none."""
    out = np.zeros(n, np.uint32)
    if doc.size:
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        place = np.arange(doc.size) - np.repeat(first, np.diff(np.append(first, doc.size)))
        total = np.add.reduceat(mix(term + mix(place.astype(np.uint64), 41), 42), first)
        out[doc[first]] = np.maximum((mix(total, 43) >> np.uint64(32)).astype(np.uint32), 1)
    return out


def fingerprints(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """A row of HASHES 32-bit values for each text; ``lexicon`` is sorted."""
    n = len(texts)
    doc, term = terms(texts)
    out = np.zeros((n, HASHES), np.uint32)
    at = np.searchsorted(lexicon, term)
    known = np.zeros(term.size, bool)
    if lexicon.size:
        known = lexicon[np.minimum(at, lexicon.size - 1)] == term
    has = np.zeros(n, bool)
    has[doc[known]] = True
    whole = known | ~has[doc]
    doc, term = doc[whole], term[whole]
    out[:, 0] = fold(doc, term, n)
    for seed in range(PER_RATE):
        value = mix(term, 50 + seed)
        own_doc, own_term = doc, term
        for rate in range(RATES):
            keep = value >> np.uint64(64 - 2 * (rate + 1)) == 0
            value, own_doc, own_term = value[keep], own_doc[keep], own_term[keep]
            out[:, 1 + rate * PER_RATE + seed] = fold(own_doc, own_term, n)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints; else the best rate's share of subsets that agree."""
    same = (a == b) & (a != 0)
    rates = same[:, 1:].reshape(len(a), RATES, PER_RATE).mean(axis=2).max(axis=1)
    return np.where((a == b).all(axis=1), 1.0, np.minimum(rates, 1.0))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH,
            id_col: str = "doc_id") -> DataFrame:
    """(term, df) of the terms in the band, counted over all documents."""
    rows = internal(docs, id_col, text_col).select("text")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(64, -(-size // BUCKET_BYTES))

    def count(batches):
        held, size = [], 0

        def merged():
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([c for _, c in held])).astype(np.uint32)

        for block in slices(batches, BLOCK):
            _, term = terms(block.column("text"))
            keys, counts = np.unique(term, return_counts=True)
            held.append((keys, counts.astype(np.uint32)))
            size += keys.size
            if size > 2_000_000:
                held = [merged()]
                size = held[0][0].size
        if size:
            keys, counts = merged()
            # Terms once here need no count: they are sent apart.
            for once in (True, False):
                sel = (counts == 1) == once
                own = keys[sel]
                bucket = ((own >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                six = own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                for b, at in by_bucket(bucket):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), pa.array([blob(six[at])], pa.binary()),
                         pa.array([None if once else blob(counts[sel][at])], pa.binary())],
                        ["bucket", "terms", "counts"])

    def add(table: pa.Table) -> pa.Table:
        keys, weights = [], []
        for t, c in zip(table.column("terms").to_pylist(), table.column("counts").to_pylist()):
            six = np.frombuffer(t, np.uint8).reshape(-1, 6)
            own = np.zeros((len(six), 8), np.uint8)
            own[:, :6] = six
            keys.append(own.view("<u8").reshape(-1))
            weights.append(np.ones(len(six), np.uint32) if c is None else np.frombuffer(c, np.uint32))
        keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        df = np.bincount(place, np.concatenate(weights)).astype(np.int64)
        sel = (df >= low * n) & (df <= high * n)
        return pa.table({"term": pa.array(keys[sel].astype(np.int64)), "df": pa.array(df[sel])})

    sent = rows.mapInArrow(count, "bucket int, terms binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add, "term long, df long")


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents in ascending id, texts compressed: ``id``, ``data``."""
    import zstandard

    rows = internal(docs, id_col, text_col).select("id", F.xxhash64("text").alias("mark"), "text")

    def press(batches):
        make = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"),
                 pa.array([make(t or b"") for t in texts], pa.binary())], ["id", "mark", "data"])

    order = [F.col("id").asc_nulls_last(), F.col("mark").asc()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pressed = rows.mapInArrow(press, "id long, mark long, data binary")
    return pressed.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def edit(text: str, following: str) -> str:
    """The last quarter replaced by the start of the next document."""
    size = len(text) // 4
    return text[:len(text) - size] + following[:size]


FOUND = "id long, n_chars long, edited_sha256 string, own binary, edited binary, near_edited double, near_next double"


def compare(ids: pa.Array, texts: list[str], nexts: list[str], own: np.ndarray, next_: np.ndarray,
            words: np.ndarray) -> pa.RecordBatch:
    edited = [edit(a, b) for a, b in zip(texts, nexts)]
    prints = fingerprints(pa.array(edited, pa.string()), words)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(t) for t in texts], pa.int64()),
         pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
         pa.array([blob(x) for x in own], pa.binary()), pa.array([blob(x) for x in prints], pa.binary()),
         pa.array(likeness(own, prints)), pa.array(likeness(own, next_))],
        ["id", "n_chars", "edited_sha256", "own", "edited", "near_edited", "near_next"])


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    low: float = LOW, high: float = HIGH) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and the next document.

    Documents are dealt out in order, so a document's next one follows it in its task,
    but for the last of each task, which meets the first of the next by a join.
    """
    import zstandard

    spark = docs.sparkSession
    found = lexicon(docs, text_col, low, high, id_col)
    found = materialize(found.select("term"), "imatch-lexicon")
    if found.count() > MOST_TERMS:
        raise ValueError(f"The lexicon has over {MOST_TERMS} terms; a higher ``low`` makes it smaller.")
    words = spark.sparkContext.broadcast(np.sort(np.array(
        [r["term"] for r in found.toLocalIterator()], np.uint64)))

    def stream(batches):
        part, unpress = TaskContext.get().partitionId(), zstandard.ZstdDecompressor().decompress
        held: list[tuple[int | None, bytes]] = []
        first, size = True, 0

        def row(kind, doc, data):
            return pa.RecordBatch.from_arrays(
                [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([doc], pa.int64()),
                 pa.array([data], pa.binary())]
                + [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(),
                                            pa.float64(), pa.float64())],
                ["kind", "part", "id", "data", "n_chars", "edited_sha256", "own", "edited", "near_edited",
                 "near_next"])

        def flush():
            texts = [d.decode() for _, d in held]
            own = fingerprints(pa.array(texts, pa.string()), words.value)
            done = compare(pa.array([i for i, _ in held[:-1]], pa.int64()), texts[:-1], texts[1:],
                           own[:-1], own[1:], words.value)
            n = done.num_rows
            cols = {c: done.column(c) for c in done.schema.names}
            cols |= {"kind": pa.array([0] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()),
                     "data": pa.nulls(n, pa.binary())}
            return pa.RecordBatch.from_arrays(
                [cols[c] for c in ("kind", "part", "id", "data", "n_chars", "edited_sha256", "own", "edited",
                                   "near_edited", "near_next")],
                ["kind", "part", "id", "data", "n_chars", "edited_sha256", "own", "edited", "near_edited",
                 "near_next"])

        for batch in batches:
            for doc, data in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist()):
                data = unpress(data) if data else b""
                if first:
                    yield row(1, doc, data)
                    first = False
                held.append((doc, data))
                size += len(data)
                if size > BLOCK or len(held) > ROWS:
                    if len(held) > 1:
                        yield flush()
                    held, size = held[-1:], len(held[-1][1])
        if held:
            if len(held) > 1:
                yield flush()
            yield row(2, *held[-1])

    columns = FOUND.replace("id long", "id long, data binary", 1)
    rows = materialize(in_order(docs, id_col, text_col).mapInArrow(
        stream, f"kind int, part int, {columns}"), "imatch")
    # One number per task that had rows.
    parts = sorted(r["part"] for r in rows.where("kind = 1").select("part").collect())
    following = dict(zip(parts, parts[1:] + parts[:1]))
    firsts = rows.where("kind = 1").select(F.col("part").alias("next_part"), F.col("data").alias("next_data"))
    lasts = rows.where("kind = 2").select("id", "part", "data")
    if following:
        after = spark.createDataFrame(list(following.items()), "part int, next_part int")
        lasts = lasts.join(after, "part").join(firsts, "next_part").select("id", "data", "next_data")
    else:
        lasts = lasts.select("id", "data", F.col("data").alias("next_data"))

    def edges(batches):
        for batch in batches:
            texts = [d.decode() for d in batch.column("data").to_pylist()]
            nexts = [d.decode() for d in batch.column("next_data").to_pylist()]
            own, next_ = (fingerprints(pa.array(t, pa.string()), words.value) for t in (texts, nexts))
            yield compare(batch.column("id"), texts, nexts, own, next_, words.value)

    names = [c.split()[0] for c in FOUND.split(", ")]
    return rows.where("kind = 0").select(*names).union(lasts.mapInArrow(edges, FOUND))
