"""Source divergence audit: how far sources of a language are apart in their term shares.

Terms are runs of ASCII letters and of all characters beyond ASCII, with A-Z lower-cased.
A language keeps the terms that are in ``least`` of its documents or more. They are found by
iceberg prefix refinement: a term is its bytes and a closing zero byte; at each level the
distinct documents of every prefix of ``width`` bytes are counted, prefixes below ``least``
are discarded with all terms that begin with them, and the others are extended to twice the
width, until what is left are whole terms. A document that has several terms with one
prefix counts once, so the count is exact at each level.

Documents are staged once in blocks (a row per block: sorted terms, which document has
which). A level is a map over the blocks and one sum. Which prefixes have survived goes to
the tasks as a bitmap of ``BITS`` bits: fixed in size. A discarded prefix that shares a
bit with a survivor is extended for nothing and is discarded a level later, as no extension
is in more documents than its prefix; so the bitmap cannot change a result.

Shares use whole numbers only: ``1 + floor(10**9 (count + 5) / (N + 5 V))``, by long division
in steps of 1000, exact for up to 9 * 10**15 occurrences. Distances of sources are sums over
blocks of terms, computed between tiles of sources, and added up.

Defined results: null text, language and source are empty ones; every row is a document,
also one that repeats another; an empty text adds its source to the groups; terms of any
length are handled, by more levels; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.exchange import press, unpress
from touchline.llm.shared import Spans, materialize, mix, ship_package, slices, text_bytes

LEAST, TOP = 30, 50
#: Bytes of the first level's prefixes; every level has twice the bytes of the one before.
WIDTH = 2
#: Bits of the set of surviving prefixes: 4 MB, sent to all tasks.
BITS = 1 << 25
#: Text bytes in a block.
BLOCK = 3 << 20
#: Kept terms of a language that are compared together, and sources in a tile.
TERMS, TILE = 8192, 128
SMOOTH, SCALE = 5, 1000

# What each byte becomes: letters in lower case, bytes beyond ASCII as they are, else a space.
_LETTER = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)],
                   np.uint8)
_BLOCK = ("block long, langs array<string>, sources array<string>, terms binary, ends binary, groups binary, "
          "pairs binary")
_ODD = np.uint64(0xD6E8FEB86659FD93)


class Numbers(dict):
    """A number for each new key."""

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number


# --- blocks --------------------------------------------------------------------------


def make_block(texts: pa.Array, langs: list[str], sources: list[str]) -> tuple:
    """One block: (languages of groups, sources of groups, sorted terms with a zero byte
    after each, their ends, the group of each document, and per term and document: term,
    document, count). Documents are numbered by language and group, entries sorted."""
    groups, names, n = Numbers(), Numbers(), len(texts)
    group = np.fromiter((groups[g] for g in zip(langs, sources)), np.int64, n)
    by = np.lexsort((group, np.fromiter((names[x] for x in langs), np.int64, n)))
    place = np.empty(n, np.int64)
    place[by] = np.arange(n)
    data, starts = text_bytes(texts)
    plain = pa.LargeStringArray.from_buffers(n, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(_LETTER[data]))
    split = pa.compute.ascii_split_whitespace(plain)
    doc = np.repeat(place, pa.compute.list_value_length(split).to_numpy())
    found = split.flatten().dictionary_encode()
    kinds, number = found.dictionary.cast(pa.large_binary()), found.indices.to_numpy()
    order = pa.compute.array_sort_indices(kinds)
    terms = kinds.take(order)
    rank = np.empty(len(terms), np.int64)
    rank[order.to_numpy()] = np.arange(len(terms))
    term = rank[number]
    del plain, split, found, number, data
    if len(terms) and not len(terms[0].as_py()):  # what is before a first and after a last separator
        terms, keep = terms[1:], term > 0
        term, doc = term[keep] - 1, doc[keep]
    nothing, zero = (pa.scalar(x, pa.large_binary()) for x in (b"", b"\0"))
    raw, starts = text_bytes(pa.compute.binary_join_element_wise(terms, nothing, zero))
    pair, count = np.unique(term * max(n, 1) + doc, return_counts=True)
    term, doc = np.divmod(pair, max(n, 1))
    return ([g[0] for g in groups], [g[1] for g in groups], raw.tobytes(), press(starts[1:].astype("<i8")),
            press(group[by].astype("<i4")), press(term.astype("<i4"), doc.astype("<i4"), count.astype("<i4")))


def stage(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The blocks of all documents, written once."""
    named = lambda c, a: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a)
    rows = docs.select(named(text_col, "text"), named(lang_col, "lang"), named(source_col, "source"))

    def blocks(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held, size = [], 0
        for piece in chain(slices(batches, BLOCK), [None]):
            n_bytes = 0 if piece is None else pa.compute.sum(pa.compute.binary_length(piece.column("text"))).as_py()
            if held and (piece is None or size + n_bytes > BLOCK):
                some = pa.Table.from_batches(held)
                held, size = [], 0
                texts = some.column("text").combine_chunks()
                made = make_block(texts, some.column("lang").to_pylist(), some.column("source").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) | seq]), *(pa.array([m], t) for m, t in zip(made, (
                        pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 4)))],
                    ["block", "langs", "sources", "terms", "ends", "groups", "pairs"])
                seq += 1
                del some, texts, made
                pa.default_memory_pool().release_unused()
            if piece is not None:
                held.append(piece)
                size += n_bytes

    return materialize(rows.mapInArrow(blocks, _BLOCK), "audit-blocks")


class Block:
    """A staged block, with one entry for each (language, term) and document."""

    def __init__(self, row: dict):
        self.langs, self.sources = row["langs"], row["sources"]
        self.data = np.frombuffer(row["terms"], np.uint8)
        self.raw = row["terms"]
        self.ends, = unpress(row["ends"], "<i8")
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.term, self.doc, self.count = unpress(row["pairs"], "<i4", "<i4", "<i4")
        self.of_doc, = unpress(row["groups"], "<i4")
        names = Numbers()
        self.of_group = np.array([names[x] for x in self.langs], np.int64)
        self.names = list(names)
        self.lang = self.of_group[self.of_doc][self.doc]
        self.seeds = np.array([_seed(x) for x in self.names], np.uint64)
        self.spans = Spans(self.data)

    def keys(self, lang: np.ndarray, term: np.ndarray, width: int | None) -> np.ndarray:
        """A 64-bit hash of each entry's language and prefix (None: whole term)."""
        end = self.ends[term] if width is None else np.minimum(self.starts[term] + width, self.ends[term])
        return mix(self.spans.of(self.starts[term], end) ^ self.seeds[lang])

    def prefix_groups(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """A number per term that terms with one prefix share, and the first term of each
        number; terms are sorted."""
        new = np.ones(self.starts.size, bool)
        size = self.ends - self.starts
        # Neighbours that agree so far; terms differ, so the shorter one ends with its zero.
        at = np.arange(1, size.size)
        for k in range(min(width, 64)):
            at = at[self.data[self.starts[at - 1] + k] == self.data[self.starts[at] + k]]
            at = at[np.minimum(size[at - 1], size[at]) > k + 1] if k + 1 < width else at
        if width > 64:
            at = np.array([k for k in at.tolist() if self.prefix(k - 1, width) == self.prefix(k, width)], np.int64)
        new[at] = False
        return np.cumsum(new) - 1, np.flatnonzero(new)

    def alive(self, lang: np.ndarray, term: np.ndarray, width: int, data: bytes) -> np.ndarray:
        """Which entries' prefixes may have survived; each language's prefix is hashed once."""
        group, first = self.prefix_groups(width)
        code = lang * first.size + group[term]
        if len(self.names) * first.size <= 4 * code.size:
            seen = np.zeros(len(self.names) * first.size, bool)
            seen[code] = True
            codes, place = np.flatnonzero(seen), (np.cumsum(seen) - 1)[code]
        else:
            codes, place = np.unique(code, return_inverse=True)
        lang, group = np.divmod(codes, max(first.size, 1))
        return _alive(self.keys(lang, first[group], width), data)[place]

    def prefixes(self, term: np.ndarray, width: int) -> pa.Array:
        offsets = np.concatenate([self.starts, self.ends[-1:]])
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), self.starts.size, [None, pa.py_buffer(offsets), pa.py_buffer(self.raw)])
        return pa.compute.binary_slice(words.take(pa.array(term)), 0, width).cast(pa.binary())

    def prefix(self, term: int, width: int) -> bytes:
        return self.raw[self.starts[term]:min(self.starts[term] + width, self.ends[term])]


def changes(*columns: np.ndarray) -> np.ndarray:
    """Which entries differ from the one before in any column; the first one does."""
    new = np.ones(columns[0].size, bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _seed(text: str) -> np.uint64:
    data = np.frombuffer(text.encode(), np.uint8)
    return (Spans(data).of(np.array([0]), np.array([data.size])) * _ODD)[0]


def _alive(keys: np.ndarray, data: bytes) -> np.ndarray:
    bitmap = np.frombuffer(data, np.uint8)
    place = keys % np.uint64(8 * bitmap.size)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _each_block(blocks: DataFrame, make, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from make(Block(row))

    return blocks.mapInArrow(run, schema)


# --- levels --------------------------------------------------------------------------


def level(blocks: DataFrame, width: int, before) -> DataFrame:
    """(lang, prefix, mark, df) of all prefixes of ``width`` bytes whose first half may have
    survived; a prefix that ends in a zero byte is a whole term."""

    def make(block: Block):
        term, doc = block.term, block.doc
        if before is not None:
            # Terms that were whole at the level before are settled.
            longer = (block.ends - block.starts > width // 2)[term]
            lang, term, doc = block.lang[longer], term[longer], doc[longer]
            live = block.alive(lang, term, width // 2, before.value)
            term, doc = term[live], doc[live]
        if not term.size:
            return
        group, heads = block.prefix_groups(width)
        # One entry for each prefix and document, then one for each prefix and language:
        # documents are numbered by language.
        n = block.of_doc.size
        key = np.sort(group[term] * n + doc)
        group, doc = np.divmod(key, n)
        lang = block.of_group[block.of_doc][doc]
        once, first = changes(key), np.flatnonzero(changes(group, lang))
        lang, term = lang[first], heads[group[first]]
        yield pa.RecordBatch.from_arrays([
            pa.array(block.names, pa.string()).take(pa.array(lang)), block.prefixes(term, width),
            pa.array(block.keys(lang, term, width).view(np.int64)),
            pa.array(np.add.reduceat(once, first, dtype=np.int64))], ["lang", "prefix", "mark", "df"])

    found = _each_block(blocks, make, "lang string, prefix binary, mark long, df long")
    return found.groupBy("lang", "prefix", "mark").agg(F.sum("df").alias("df"))


def _whole() -> Column:
    return F.substring("prefix", -1, 1) == F.lit(b"\0")


def survivors_bitmap(rows: DataFrame, bits: int = BITS) -> bytes:
    """``bits`` bits (a power of two, 2**15 at least) with those of the rows' marks set: as
    many bytes whatever the rows are."""
    place = F.expr(f"(mark & {bits - 1}) + 1")
    pieces = rows.groupBy(F.bitmap_bucket_number(place).alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")).collect()
    out = bytearray(bits // 8)
    for row in pieces:  # at most bits / 2**15 pieces of 4 KB, numbered from 1
        out[(row["piece"] - 1) * 4096:row["piece"] * 4096] = row["bitmap"]
    return bytes(out)


def kept_terms(blocks: DataFrame, least: int = LEAST, width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """(lang, term, df) of the terms in ``least`` documents of a language or more; ``term``
    is bytes."""
    spark, before, done = blocks.sparkSession, None, []
    while True:
        rows = materialize(level(blocks, width, before).where(F.col("df") >= least), "audit-level")
        done.append(rows.where(_whole()).select(
            "lang", F.expr("substring(prefix, 1, octet_length(prefix) - 1)").alias("term"), "df", "mark"))
        open_ = rows.where(~_whole())
        if open_.isEmpty():
            break
        if before is not None:
            before.unpersist()
        before = spark.sparkContext.broadcast(survivors_bitmap(open_, bits))
        width *= 2
    every = done[0]
    for rows in done[1:]:
        every = every.unionByName(rows)
    return every


# --- counts --------------------------------------------------------------------------


def term_counts(blocks: DataFrame, kept: DataFrame, bits: int = BITS) -> DataFrame:
    """(lang, source, term, count) of kept terms that occur; one row per task at most is
    forwarded for each."""
    bitmap = kept.sparkSession.sparkContext.broadcast(survivors_bitmap(kept, bits))

    def cells(batches):
        """The blocks of a task together, so that it forwards a cell once."""
        terms, groups, held, size = Numbers(), Numbers(), [], 0

        def merged():
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([c for _, c in held])).astype(np.int64)

        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                if not block.term.size:
                    continue
                # Entries come by term, then by language, then by group.
                term, group = block.term, block.of_doc[block.doc]
                first = np.flatnonzero(changes(term, group))
                count = np.add.reduceat(block.count, first, dtype=np.int64)
                term, group = term[first], group[first]
                lang = block.of_group[group]
                new = changes(term, lang)
                live = _alive(block.keys(lang[new], term[new], None), bitmap.value)[np.cumsum(new) - 1]
                term, group, count = term[live], group[live], count[live]
                if not term.size:
                    continue
                number = np.array([groups[g] for g in zip(block.langs, block.sources)], np.int64)
                new = changes(term)
                own, place = term[new], np.cumsum(new) - 1
                known = np.array([terms[block.raw[a:b]] for a, b in zip(
                    block.starts[own].tolist(), (block.ends[own] - 1).tolist())], np.int64)
                held.append((known[place] << 24 | number[group], count))
                size += count.size
                if size > 500_000:
                    held = [merged()]
                    size = held[0][0].size
        if not size:
            return
        keys, counts = merged()
        term, group = keys >> 24, keys & 0xFFFFFF
        words = pa.array(list(terms), pa.binary())
        langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
        for at in range(0, keys.size, 100_000):
            here = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(group[here])), sources.take(pa.array(group[here])),
                 words.take(pa.array(term[here])), pa.array(counts[here])], ["lang", "source", "term", "count"])

    found = blocks.mapInArrow(cells, "lang string, source string, term binary, count long")
    summed = found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))
    return summed.join(kept.select("lang", "term"), ["lang", "term"], "left_semi")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / total) in three steps of whole numbers."""
    rest, out = count + F.lit(SMOOTH), F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * SCALE
        out = out * SCALE + F.call_function("div", rest, total)
        rest = rest % total
    return out + 1


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same in numpy."""
    rest, out = count + SMOOTH, 0
    for _ in range(3):
        rest = rest * SCALE
        out = out * SCALE + rest // total
        rest = rest % total
    return out + 1


# --- distances -----------------------------------------------------------------------


def distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of a language's sources: the sum
    of the differences of their shares over all kept terms.

    ``groups``: (lang, source, total, v, empty), a row for each source; ``empty`` is the share
    of a term that the source lacks. Sources are dealt to tiles and terms to blocks; a task
    gets two tiles of sources and one block of terms. Terms that neither tile has are added
    at the end, by their number."""
    keys = ["lang", "left", "right", "part"]
    per_lang = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / TILE).alias("tiles"),
        F.greatest(F.ceil(F.max("v") / TERMS), F.lit(1)).alias("parts"))
    tiled = groups.join(per_lang, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # A tile meets every tile, itself included, once: as the left or as the right one.
    met = tiled.withColumn("other", F.explode(upto(F.col("tiles")))).withColumns(
        {"left": F.least("tile", "other"), "right": F.greatest("tile", "other")})
    sides = met.withColumn("part", F.explode(upto(F.col("parts")))).select(*keys, "source", "tile", "total")
    cells = counts.join(met.select("lang", "source", "parts", "left", "right"), ["lang", "source"]).select(
        # Aliases: both sides of the cogroup come from ``met``.
        *[F.col(c).alias(c) for c in ("lang", "left", "right")],
        F.pmod(F.xxhash64("term"), F.col("parts")).alias("part"), "source", "term", "count")

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = left.column("source").to_pylist()
        row_of = {name: k for k, name in enumerate(names)}
        tile, total = left.column("tile").to_numpy(), left.column("total").to_numpy()
        width, count = 0, np.zeros((len(names), 0), np.int64)
        if right.num_rows:
            term = right.column("term").combine_chunks().dictionary_encode()
            width = len(term.dictionary)
            count = np.zeros((len(names), width), np.int64)
            at = [row_of[s] for s in right.column("source").to_pylist()]
            count[at, term.indices.to_numpy()] = right.column("count").to_numpy()
        share = shares(count, total[:, None])
        a, b = key[1].as_py(), key[2].as_py()
        lefts, rights = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
        value = np.stack([np.abs(share[rights] - share[i]).sum(axis=1) for i in lefts]) if lefts.size else (
            np.zeros((0, rights.size), np.int64))
        i, j = (x.reshape(-1) for x in np.meshgrid(lefts, rights, indexing="ij"))
        f = value.reshape(-1)
        if a == b:
            i, j, f = i[i != j], j[i != j], f[i != j]
        else:
            i, j, f = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([f, f])
        name = np.array(names, object)
        return pa.table({
            "lang": pa.array([key[0].as_py()] * f.size, pa.string()), "source": pa.array(name[i], pa.string()),
            "item": pa.array(name[j], pa.string()), "value": pa.array(f, pa.int64()),
            "seen": pa.array(np.full(f.size, width, np.int64))})

    found = sides.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInArrow(
        compare, "lang string, source string, item string, value long, seen long")
    summed = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    own = groups.select("lang", "source", "v", "empty")
    other = groups.select("lang", F.col("source").alias("item"), F.col("empty").alias("other_empty"))
    return summed.join(own, ["lang", "source"]).join(other, ["lang", "item"]).select(
        "lang", "source", "item",
        (F.col("value") + (F.col("v") - F.col("seen")) * F.abs(F.col("empty") - F.col("other_empty"))).alias("value"))


def overused(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of kept terms that a group has and whose share in it is
    above the language's."""
    of_lang = counts.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"))
    totals = groups.select("lang", "source", "total", F.sum("n").over(Window.partitionBy("lang")).alias("lang_n"), "v")
    met = counts.join(totals, ["lang", "source"]).join(of_lang, ["lang", "term"])
    value = share(F.col("count"), F.col("total")) - share(F.col("lang_count"), F.col("lang_n") + SMOOTH * F.col("v"))
    return met.select("lang", "source", F.col("term").cast("string").alias("item"), value.alias("value")).where("value > 0")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *,
          least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has a row for each other source
    of the language, part ``term`` the ``top`` kept terms that a group uses beyond its
    language's share; ranks by value, largest first, then by item."""
    ship_package(docs.sparkSession)
    blocks = stage(docs, text_col, lang_col, source_col)
    kept = kept_terms(blocks, least, bits=bits)
    counts = materialize(term_counts(blocks, kept, bits), "audit-counts")
    pairs = blocks.select(F.explode(F.arrays_zip("langs", "sources")).alias("g")).select(
        F.col("g.langs").alias("lang"), F.col("g.sources").alias("source")).distinct()
    sizes = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    zero = F.lit(0).cast("long")
    groups = pairs.join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left").select(
        "lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v")).withColumn(
        # A language without kept terms has no shares; its total only must not be zero.
        "total", F.greatest(F.col("n") + SMOOTH * F.col("v"), F.lit(SMOOTH).cast("long")))
    groups = materialize(groups.withColumn("empty", share(zero, F.col("total"))), "audit-groups")
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    far = distances(counts, groups).withColumns({"part": F.lit("pair"), "rank": F.row_number().over(ranked)})
    over = overused(counts, groups).withColumns({"part": F.lit("term"), "rank": F.row_number().over(ranked)})
    return far.select(*columns).unionByName(over.where(F.col("rank") <= top).select(*columns))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
                     coalesce(source, '') AS source FROM documents),
cells AS (SELECT doc, lang, source, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM cells GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM cells SEMI JOIN kept USING (lang, term)
            GROUP BY lang, source, term),
by_source AS (SELECT lang, source, sum(n) AS n FROM counted GROUP BY lang, source),
by_term AS (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term),
by_lang AS (SELECT lang, sum(n) AS n FROM counted GROUP BY lang),
shares AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
                  1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(b.n, 0) + 5 * v) AS p
           FROM sources s JOIN kept k USING (lang) JOIN sizes USING (lang)
           LEFT JOIN counted c USING (lang, source, term) LEFT JOIN by_source b USING (lang, source)),
lang_shares AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (t.n + 5)) // (l.n + 5 * v) AS q
                FROM by_term t JOIN by_lang l USING (lang) JOIN sizes USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
        GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
          FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
over AS (SELECT lang, source, term AS item, p - q AS value FROM shares JOIN lang_shares USING (lang, term)
         WHERE n > 0 AND p > q),
every AS (SELECT *, 'pair' AS part FROM pairs UNION ALL BY NAME SELECT *, 'term' AS part FROM over)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= 50"""
