"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

Distinct fingerprints are sorted by their population counts (of the whole and of each
16-bit lane) and packed into blocks. Blocks are dealt to the cells of a square grid, so
that a block travels once for each side of the grid, not for each other block. In a cell,
blocks meet when their ranges of population counts come within the radius, and their tiles
are compared by exclusive-or and bit count. Each lane's difference in population count is
a lower bound for the bits that differ in it, so tiles whose bounds sum to more than the
radius are skipped; no pair within the radius is missed. A pair of blocks returns a
spanning forest of its links, never all pairs, and components are found by alternating
large-star and small-star rounds, each written to the shared folder.

Defined results: a null or empty text has the fingerprint zero and links like any other;
a null id belongs to its component, and the component's id is the smallest id that is not
null, or null; repeated rows and equal texts share a fingerprint, which is compared once;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import external, internal, materialize, slices

SHINGLE, RADIUS = 4, 4
#: Fingerprints in a block, the unit that is sent, and in a tile, the unit compared.
BLOCK, TILE = 16_384, 1_024
#: Blocks of one side of a cell of the grid at most, and the least number of sides.
SIDE, SIDES = 256, 12
#: A fingerprint with more than one in so many rows is broadcast; there are fewer than that.
HEAVY = 1000
LANES = 4


def fingerprint_of(text: bytes, shingle: int) -> int:
    """Bit i is set when over half of the shingles' XXH64 (seed 42) have it set."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words))
    stops = ends[width - 1:].tolist()
    begins = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    xxh = xxhash.xxh64_intdigest
    hashes = np.array([xxh(line[a:b], 42) for a, b in zip(begins, stops)], np.uint64)
    ones = np.zeros(64, np.int64)
    for part in range(0, hashes.size, 65_536):
        block = hashes[part:part + 65_536]
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_ = np.packbits(2 * ones > hashes.size, bitorder="little")
    return int(set_.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """``id``, ``fp`` (the 64 bits as a long) and ``mark``, a hash of the whole text."""
    rows = internal(docs, id_col, text_col).select("id", "text", F.xxhash64("text").alias("mark"))

    def compute(batches):
        for block in slices(batches):
            texts = block.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint_of(t or b"", shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(fps.view(np.int64)), block.column("mark")],
                ["id", "fp", "mark"])

    return rows.mapInArrow(compute, "id long, fp long, mark long")


def lane_counts(fps: np.ndarray) -> np.ndarray:
    """Set bits of each lane: an array of LANES columns."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, LANES)).astype(np.int16)


def _boxes(counts: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(counts), tile)
    return np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool, tile: int = TILE) -> np.ndarray:
    """Links between two sorted blocks, as far as they join parts not yet joined."""
    label = np.arange(a.size + (0 if same else b.size))
    shift = 0 if same else a.size
    low_a, high_a = _boxes(lane_counts(a), tile)
    low_b, high_b = _boxes(lane_counts(b), tile)
    out = []

    def root(x):
        while (up := label[x]) != x:
            label[x] = label[up]
            x = label[x]
        return x

    for i in range(len(low_a)):
        gap = np.maximum(0, np.maximum(low_a[i] - high_b, low_b - high_a[i])).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            left, right = a[i * tile:(i + 1) * tile], b[j * tile:(j + 1) * tile]
            near = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
            if same and i == j:
                near &= np.tri(left.size, right.size, -1, dtype=bool)
            x, y = np.nonzero(near)
            x, y = x + i * tile, y + j * tile
            while x.size:
                while not np.array_equal(up := label[label], label):
                    label = up
                lx, ly = label[x], label[y + shift]
                apart = lx != ly
                x, y, lx = x[apart], y[apart], lx[apart]
                _, one = np.unique(lx, return_index=True)
                for u, v in zip(x[one].tolist(), y[one].tolist()):
                    ru, rv = root(u), root(v + shift)
                    if ru != rv:
                        label[max(ru, rv)] = min(ru, rv)
                        out.append((a[u], b[v]))
    return np.array(out, np.uint64).reshape(-1, 2)


def _block_rows(fps: DataFrame, n: int) -> DataFrame:
    """Distinct fingerprints, packed into blocks sorted by population counts."""
    lane = [F.bit_count(F.expr(f"shiftright(fp, {16 * k}) & 65535")) for k in range(LANES)]
    order = ["total", *[f"lane{k}" for k in range(LANES)]]
    keyed = fps.select("fp", F.bit_count("fp").alias("total"),
                       *[c.alias(f"lane{k}") for k, c in enumerate(lane)])
    parts = max(1, -(-n // BLOCK))
    dealt = keyed.repartitionByRange(parts, *order, "fp").sortWithinPartitions(*order, "fp")

    def pack(batches):
        part, seq, rest = TaskContext.get().partitionId(), 0, np.zeros(0, np.uint64)

        def row(block, seq):
            counts = np.bitwise_count(block)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | seq]), pa.array([int(counts.min())]),
                 pa.array([int(counts.max())]), pa.array([block.tobytes()], pa.binary())],
                ["block", "low", "high", "data"])

        for batch in batches:
            rest = np.concatenate([rest, batch.column("fp").to_numpy().view(np.uint64)])
            while rest.size > 2 * BLOCK:
                yield row(rest[:BLOCK], seq)
                rest, seq = rest[BLOCK:], seq + 1
        if rest.size:
            yield row(rest, seq)

    return dealt.select("fp").mapInArrow(pack, "block long, low long, high long, data binary")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints within the radius: enough of them that all
    within the radius are connected."""
    n = fps.count()
    blocks = materialize(_block_rows(fps, n), "simhash-blocks")
    sides = max(SIDES, -(-n // (SIDE * BLOCK)))
    cells = sides * (sides + 1) // 2
    # A block goes to the cells of its side, once to each other side.
    side, other = F.pmod(F.xxhash64("block"), F.lit(sides)), F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))
    dealt = blocks.withColumn("side", side.cast("int")).withColumn("other", other).withColumns(
        {"x": F.least("side", "other"), "y": F.greatest("side", "other")}).drop("other")
    # As many tasks as cells, so their number follows the blocks.
    dealt = dealt.repartition(2 * cells, "x", "y")

    def compare(key, cell):
        rows = cell.select(["side", "block", "low", "high"]).to_pylist()
        data = [np.frombuffer(d.as_buffer(), np.uint64) for d in cell.column("data")]
        out = [np.zeros((0, 2), np.int64)]
        x, y = key[0].as_py(), key[1].as_py()
        for i, a in enumerate(rows):
            for j, b in enumerate(rows):
                mine = (a["block"] <= b["block"]) if x == y else (a["side"] == x and b["side"] == y)
                # No pair of blocks whose population counts are further apart.
                if mine and a["low"] - radius <= b["high"] and b["low"] - radius <= a["high"]:
                    out.append(forest(data[i], data[j], radius, a["block"] == b["block"]).view(np.int64))
        found = np.concatenate(out)
        return pa.table({"u": pa.array(found[:, 0]), "v": pa.array(found[:, 1])})

    return dealt.groupBy("x", "y").applyInArrow(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges, root being the component's smallest.

    Large-star and small-star in turn until no edge changes. The smallest neighbour is an
    aggregate and comes back by a join, so a node with very many links is no single task.
    """
    edges = materialize(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "star")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document ``id``, ``fp``, ``mark``, ``root``, the fingerprint that tells its
    component from others, and ``component``, the smallest id it is linked with."""
    marked = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(
        F.min("id").alias("least"), F.count("*").alias("n_rows")), "simhash-distinct")
    tree = materialize(components(links(distinct.select("fp"), radius)), "simhash-roots")
    linked = distinct.join(tree, distinct.fp == tree.node).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("joined"))
    known = linked.join(least, "root").select("fp", "root", "joined")
    classes = distinct.join(known, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("joined", "least").alias("component"),
        "n_rows")
    # Fewer than HEAVY fingerprints have so many rows: they need no shuffle of theirs.
    total = distinct.agg(F.sum("n_rows")).first()[0] or 0
    heavy = materialize(classes.where(F.col("n_rows") * HEAVY > total).drop("n_rows"), "simhash-heavy")
    light = classes.where(F.col("n_rows") * HEAVY <= total).drop("n_rows")
    often = marked.join(F.broadcast(heavy), "fp")
    seldom = marked.join(F.broadcast(heavy.select("fp")), "fp", "left_anti").join(light, "fp")
    return often.unionByName(seldom)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id.

    Null ids come last. Where several rows of the component have that id, one with the
    smallest hash of its text stays.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    named = found.where("id <=> component")
    first = named.groupBy("root", "component").agg(F.min("mark").alias("mark"))
    # These rows of a root have one id: equal texts are copies of a row.
    copies = named.groupBy(F.col("root").alias("own"), F.col("mark").alias("chosen_mark")).agg(
        F.count("*").alias("copies"))
    chosen = first.join(copies, F.expr("root = own and mark = chosen_mark")).select(
        F.col("component").alias("chosen"), "chosen_mark", "copies")
    chosen = materialize(chosen, "simhash-kept")
    rows = internal(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    kept = rows.join(chosen, F.expr("id <=> chosen and mark = chosen_mark"))
    fields = [c for c in rows.columns if c != "mark"]
    once = kept.where("copies = 1").select(*fields)
    again = kept.where("copies > 1").groupBy("id", "mark").agg(
        F.first(F.struct(*fields)).alias("one")).select("one.*")
    return external(once.union(again), docs.columns, id_col, text_col)
