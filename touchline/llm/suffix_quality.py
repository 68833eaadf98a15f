"""Quality rules on repetition inside a document, read off its suffix array.

The suffixes of each document, word by word, are sorted by prefix doubling: a round
sorts only suffixes that still share their first 2**k words with another. The ranks of
all rounds give the longest common prefix of neighbours in the sorted order, hence the
intervals of suffixes that share a prefix: each interval is a maximal repeated substring.
The spans of all repeats of ``min_repeat`` words or more are united; a document fails
when they cover more than ``max_covered`` of its words or one repeat is longer than
``max_repeat`` words.

Defined results: a null or empty text has no words and fails the base rule; null ids are
returned as they are; repeated rows are judged one by one; an empty table gives no rows.
Everything happens inside one document, so there is no exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm.shared import (
    SPACE, Chunk, Spans, counts_in, cover, external, internal, mix, owner, slices, word_bounds)

#: Text bytes that are sorted together.
BLOCK = 1 << 20
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 10, 0.5, 200

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def longest_repeats(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each place the words of the longest repeat in its document that starts there.

    ``words`` are numbers of words, ``bounds`` the documents' boundaries among them.
    """
    n = words.size
    if not n:
        return np.zeros(0, np.int64)
    # Numbers of 32 bits: a block has no more words than that.
    kind = np.int32
    doc = owner(bounds).astype(kind)
    stop = bounds[1:].astype(kind)[doc]
    # Rank: the first slot of the suffix's group in the sorted order.
    order = np.lexsort((words, doc)).astype(kind)
    new = np.ones(n, bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (words[order][1:] != words[order][:-1])
    del doc
    rank = np.empty(n, kind)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=kind), 0))
    levels, width = [rank.copy()], 1
    shared = np.ones(n + 1, bool)
    shared[:-1] = new
    open_ = order[~(shared[:-1] & shared[1:])]
    del order
    while open_.size:
        ahead = open_ + kind(width)
        inside = ahead < stop[open_]
        key = np.where(inside, rank[np.minimum(ahead, n - 1)] + kind(1), kind(0))
        by = np.lexsort((key, rank[open_])).astype(kind)
        open_, key = open_[by], key[by]
        old = rank[open_]
        first = np.ones(open_.size, bool)
        first[1:] = old[1:] != old[:-1]
        new = first.copy()
        new[1:] |= key[1:] != key[:-1]
        at = np.arange(open_.size, dtype=kind)
        in_group = at - np.maximum.accumulate(np.where(first, at, 0))
        lead = np.maximum.accumulate(np.where(new, at, 0))
        rank[open_] = old + in_group[lead]
        shared = np.ones(open_.size + 1, bool)
        shared[:-1] = new
        open_ = open_[~(shared[:-1] & shared[1:])]
        levels.append(rank.copy())
        width *= 2
    suffixes = np.empty(n, kind)
    suffixes[rank] = np.arange(n, dtype=kind)
    del rank
    left, right = suffixes[:-1], suffixes[1:]
    common = np.zeros(n + 1, kind)
    live = np.flatnonzero(levels[0][left] == levels[0][right]).astype(kind)
    i, j = left[live], right[live]
    got = np.zeros(live.size, kind)
    while levels:  # the widest first; each is used once
        own = levels.pop()
        a, b = i + got, j + got
        same = (a < stop[i]) & (b < stop[j])
        same &= own[np.minimum(a, n - 1)] == own[np.minimum(b, n - 1)]
        got += same * kind(1 << len(levels))
    common[live + 1] = got
    best = np.empty(n, np.int64)
    best[suffixes] = np.maximum(common[:-1], common[1:])
    return best


def duplicate_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, again = set(), 0
    for line in lines:
        if line.split():
            again += line in seen
            seen.add(line)
    return again


def measure(block: pa.RecordBatch, min_repeat: int) -> dict[str, np.ndarray]:
    """The figures of each document of a block."""
    chunk = Chunk(block)
    data, starts = chunk.data, chunk.starts
    begin, end, bounds = word_bounds(data, starts)
    n_words = np.diff(bounds)
    best = longest_repeats(Spans(data).of(begin, end), bounds)
    places = np.arange(best.size)
    triple, long_ = best >= 3, best >= min_repeat
    longest = np.zeros(n_words.size, np.int64)
    np.maximum.at(longest, owner(bounds), best)
    return {
        "n_words": n_words,
        "word_chars": counts_in(~SPACE[data] & ((data & 0xC0) != 0x80), starts),
        "n_symbols": counts_in(SYMBOLS[data], starts),
        "n_dup_lines": np.array([duplicate_lines(t) for t in chunk.texts()], np.int64),
        "n_repeat_words": counts_in(cover(places[triple], places[triple] + 3, best.size), bounds),
        "n_covered": counts_in(cover(places[long_], places[long_] + best[long_], best.size), bounds),
        "longest_repeat": longest,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered",
          "longest_repeat")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
            min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
            max_repeat: int = MAX_REPEAT, carry: bool = False) -> DataFrame:
    """Each document's figures and verdict; with ``carry`` also ``text`` and ``rest``."""
    rows = internal(docs, id_col, text_col)
    if not carry:
        rows = rows.select("id", "text")
    kept_columns = [c for c in rows.columns if carry or c == "id"]

    def judge(batches):
        for block in slices(batches, BLOCK):
            found = measure(block, min_repeat)
            n, covered = found["n_words"], found["n_covered"]
            base = (n < 50) | (100 * found["n_repeat_words"] > 50 * n)
            kept = ~base & (covered <= max_covered * n) & (found["longest_repeat"] <= max_repeat)
            yield pa.RecordBatch.from_arrays(
                [block.column(c) for c in kept_columns]
                + [pa.array(found[c], pa.int64()) for c in COUNTS]
                + [pa.array(base), pa.array(kept)],
                [*kept_columns, *COUNTS, "base_failed", "kept"])

    schema = ", ".join([f"{c} {t}" for c, t in rows.dtypes if c in kept_columns]
                       + [f"{c} long" for c in COUNTS] + ["base_failed boolean, kept boolean"])
    return rows.mapInArrow(judge, schema)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The documents that pass, with all their columns unchanged."""
    passed = quality(docs, id_col, text_col, carry=True, **rules).where("kept")
    return external(passed, docs.columns, id_col, text_col)
