"""Substring dedup by recompression.

Each document is a row of symbols, at first its words. A round names maximal runs of one
symbol, then pairs of a left and a right symbol (the side is a bit of the symbol's name
that changes with the round). Names are hashes of what they stand for, so a round names
globally: equal parts get equal names everywhere, in whatever task they are. For every
symbol the words that settle it are known, its *support*. Wherever a window of
``words`` words occurs, the symbols whose support lies inside it are the same, so the
longest of them (ties: the smallest name) is an anchor that equal windows share, and so
are the words of its support, by which anchors are told apart.

1. Spark round over names: chunks send their windows' anchors, and the symbols of higher
   levels that stand for ``words`` words or more, to buckets, which say which are shared.
   Windows without a shared anchor occur once, and are done.
2. Spark round over high-level symbols: shared ones, verified by a second hash of all their
   words, get the smallest id that has each. A symbol that a smaller id has is a repeat over
   its whole span: all windows in it go, however long it is, and are not looked at again.
3. Spark round over windows, at the ends of such repeats, in short ones, and in the document
   that has a repeat first: what is left is named by all its words, 96 bits, and buckets find
   the smallest id of each name.
4. Each document removes the words that the two rounds found in a smaller id.

A document that has a symbol from a smaller id need not tell of the windows in it: the one
with the smallest id does.

Defined results: a null or empty text has no words; documents with fewer than ``words``
words lose none; a null id counts as larger than every other; rows with one id (repeated
rows, too) never remove words from each other; an empty table gives no rows. Runs are
single symbols, so periodic texts of any length take few rounds; a text of any length is
handled, in one task, with some 45 bytes of memory per byte of text.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import exchange as X
from touchline.llm.shared import (
    Chunk, Spans, blob, bucket_of, buckets_for, by_bucket, counts_in, cover, external, internal, mix,
    owner, runs, stage_chunks, word_bounds)

WORDS = 13
#: Rounds whose symbols can be anchors; those that outgrow a window are of no use to it.
ROUNDS = 5
#: Rounds in all: symbols of the last stand for some thousands of words.
LEVELS = 24
#: Text bytes per bucket.
BUCKET_BYTES = 16 << 20
FAR = 1 << 40


def rounds(words: np.ndarray, bounds: np.ndarray, count: int):
    """After each round: names, the words ``[begin, end)`` they stand for, and supports
    ``[low, high)``."""
    name = mix(words, 11)
    n = name.size
    begin, end = np.arange(n), np.arange(1, n + 1)
    low, high, doc = begin.copy(), end.copy(), owner(bounds)
    for number in range(1, count + 1):
        if not name.size:
            return
        # Runs. To know where one ends, both neighbours have to be known.
        same = np.zeros(name.size + 1, bool)
        same[1:-1] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
        first = np.flatnonzero(~same[:-1])
        last = np.flatnonzero(~same[1:])
        left, right = _neighbours(doc, first, last)
        new_low = np.minimum(low[first], np.where(left, low[np.maximum(first - 1, 0)], -FAR))
        new_high = np.maximum(high[last], np.where(right, high[np.minimum(last + 1, name.size - 1)], FAR))
        size = (last - first + 1).astype(np.uint64)
        names = name[first]
        names = np.where(size > 1, mix(names ^ mix(size, 5), 6), names)
        name, begin, end, low, high, doc = names, begin[first], end[last], new_low, new_high, doc[first]
        # Pairs of a left and a right symbol.
        n = name.size
        is_left = (mix(name, 100 + number) & np.uint64(1)).astype(bool)
        pair = np.zeros(n + 1, bool)  # pair[i]: i and i + 1 become one
        pair[:n - 1] = is_left[:-1] & ~is_left[1:] & (doc[1:] == doc[:-1])
        heads = np.ones(n, bool)
        heads[1:] = ~pair[:n - 1]
        at = np.flatnonzero(heads)
        paired = pair[at]
        tail = at + paired
        has_left, has_right = _neighbours(doc, at, tail)
        alone_left, alone_right = ~paired & is_left[at], ~paired & ~is_left[at]
        # A left symbol stays alone because of what follows it, a right one because of what precedes it.
        new_low = np.minimum(low[at], low[tail])
        new_high = np.maximum(high[at], high[tail])
        after = np.where(has_right, high[np.minimum(tail + 1, n - 1)], FAR)
        before = np.where(has_left, low[np.maximum(at - 1, 0)], -FAR)
        new_high = np.where(alone_left, np.maximum(new_high, after), new_high)
        new_low = np.where(alone_right, np.minimum(new_low, before), new_low)
        names = np.where(paired, mix(mix(name[at], 7) + name[tail], 8), name[at])
        name, begin, end, low, high, doc = names, begin[at], end[tail], new_low, new_high, doc[at]
        yield name, begin, end, low, high


def _neighbours(doc, first, last):
    left = np.zeros(first.size, bool)
    right = np.zeros(first.size, bool)
    left[1:] = doc[first[1:]] == doc[first[1:] - 1]
    right[:-1] = doc[last[:-1]] == doc[last[:-1] + 1]
    return left, right


def windows(bounds: np.ndarray, width: int) -> np.ndarray:
    """First words of all windows that lie in one document."""
    n = int(bounds[-1])
    fits = np.zeros(n, bool)
    for_doc = bounds[1:] - width
    fits = np.arange(n) <= for_doc[owner(bounds)]
    return np.flatnonzero(fits)


def reveal(words: np.ndarray, bounds: np.ndarray, width: int):
    """For each place the anchor of the window that starts there (any, if none does), and the
    symbols that stand for ``width`` words or more: names and ``[begin, end)``."""
    n = words.size
    best = np.zeros(n + width, np.uint64)
    where = np.zeros(n + width, np.int64)  # the anchor's support: start and size
    wide = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for number, (name, begin, end, low, high) in enumerate(rounds(words, bounds, LEVELS)):
        big = np.flatnonzero(end - begin >= width)
        wide.append((name[big], begin[big], end[big]))
        if number >= ROUNDS:
            continue
        fit = high - low <= width
        name, span, low, high = name[fit], (end - begin)[fit], low[fit], high[fit]
        key = (span.astype(np.uint64) << np.uint64(56)) | (~name >> np.uint64(8))
        size = high - low
        support = low * 256 + size
        for back in range(width):
            if back:
                keep = size + back <= width
                key, low, size, support = key[keep], low[keep], size[keep], support[keep]
            if not low.size:
                break
            at = low - back
            ok = at >= 0
            at, own = at[ok], key[ok]
            np.maximum.at(best, at, own)
            won = best[at] == own
            where[at[won]] = support[ok][won]
    # A window inside one run, or between unsettled symbols, is known by its words alone.
    bare = best[:n] == 0
    low = where[:n] >> 8
    best[:n] = Spans.over(mix(words, 12)).of(low, low + (where[:n] & 255))
    if bare.any():
        least = mix(words, 11)
        padded = np.concatenate([least, np.full(width, ~np.uint64(0))])
        at = np.flatnonzero(bare)
        low = padded[at]
        for k in range(1, width):
            low = np.minimum(low, padded[at + k])
        best[at] = low >> np.uint64(8)
    name, begin, end = (np.concatenate(x) for x in zip(*wide))
    # A symbol that a round leaves as it is comes again after it.
    order = np.lexsort((end, begin))
    new = np.ones(order.size, bool)
    new[1:] = (begin[order][1:] != begin[order][:-1]) | (end[order][1:] != end[order][:-1])
    once = order[new]
    return mix(best[:n], 3), (mix(name[once], 4), begin[once], end[once])


def parse(chunk: Chunk):
    begin, end, bounds = word_bounds(chunk.data, chunk.starts)
    return Spans(chunk.data).of(begin, end) if begin.size else np.zeros(0, np.uint64), bounds


class Names:
    """A chunk's windows and wide symbols with what the first Spark round calls them."""

    def __init__(self, chunk: Chunk, width: int, buckets: int):
        self.words, self.bounds = parse(chunk)
        anchors, (self.symbol, self.begin, self.end) = reveal(self.words, self.bounds, width)
        self.at = windows(self.bounds, width)
        of = owner(self.bounds)
        self.doc, self.symbol_doc = of[self.at], of[self.begin]
        keys, place = np.unique(X.small_keys(anchors[self.at], buckets), return_inverse=True)
        wide, where = np.unique(X.small_keys(self.symbol, buckets), return_inverse=True)
        # Symbols go to buckets of their own.
        self.keys = np.concatenate([keys, wide + (np.uint64(buckets) << np.uint64(32))])
        self.place, self.where = place, where + keys.size

    def several(self) -> np.ndarray:
        """Which keys several documents of the chunk have."""
        return several_documents(np.concatenate([self.place, self.where]),
                                 np.concatenate([self.doc, self.symbol_doc]), self.keys.size)


def several_documents(place: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    last[place] = doc  # the last one stays
    first[place[::-1]] = doc[::-1]
    return first != last


_FACTORS = mix(np.arange(1, 257), 21) | np.uint64(1)
_OTHERS = mix(np.arange(1, 257), 22) | np.uint64(1)


def window_names(words: np.ndarray, at: np.ndarray, width: int):
    """A 64-bit key of all words of each window, and a 32-bit check of it."""
    key, check = np.zeros(at.size, np.uint64), np.zeros(at.size, np.uint64)
    for k in range(width):
        word = words[at + k]
        key = mix(key + word * _FACTORS[k % 256])
        check += mix(word, 31) * _OTHERS[k % 256]
    return key, (mix(check, 32) >> np.uint64(32)).astype(np.uint32)


def named(words, at, ids, width):
    """Sorted distinct keys of windows, their checks and smallest ids, and places."""
    key, check = window_names(words, at, width)
    keys, first, place = np.unique(key, return_index=True, return_inverse=True)
    return keys, check[first], least_of(place, ids, keys.size), place


def least_of(place: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The smallest id at each of n places."""
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, place, ids)
    return least


def improved(least: np.ndarray, keys: np.ndarray, got: dict, buckets: int, shift: int = 0) -> np.ndarray:
    """The smallest ids after the answers of the buckets (numbered from ``shift``)."""
    least = least.copy()
    for bucket, at in by_bucket(bucket_of(keys, buckets).astype(np.int64)):
        if bucket + shift in got:
            entry, ids = X.better_owners(got[bucket + shift][0])
            least[entry + at.start] = ids
    return least


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = WORDS, carry: bool = False) -> DataFrame:
    """Per document id, n_words, n_removed, kept (the words left, joined by a space) and
    removed: the maximal removed runs as spans of words; with ``carry`` also text, rest."""
    rows = internal(docs, id_col, text_col)
    if not carry:
        rows = rows.select("id", "text")
    chunks = stage_chunks(rows, "substring-chunks")
    buckets = buckets_for(chunks, BUCKET_BYTES)

    def ask(number: int, chunk: Chunk):
        names = Names(chunk, width, buckets)
        return X.send_small(number, names.keys, names.several())

    shared = X.shared_keys(X.each_chunk(chunks, ask))

    def tell_symbols(number: int, chunk: Chunk, got: dict) -> pa.Table:
        names = Names(chunk, width, buckets)
        state = X.states(names.keys, got) > 0
        wide = np.flatnonzero(state[names.where])
        begin, end = names.begin[wide], names.end[wide]
        check = (Spans.over(mix(names.words, 13)).of(begin, end) >> np.uint64(32)).astype(np.uint32)
        keys, first, place = np.unique(names.symbol[wide], return_index=True, return_inverse=True)
        least = least_of(place, chunk.ids[names.symbol_doc[wide]], keys.size)
        open_ = np.packbits(state[names.place])
        sent = [X.to_itself(number, X.packed(open_, X.press(keys, least), X.press(
            begin.astype("<i4"), end.astype("<i4"), place.astype("<i4"))))]
        return X.messages(sent + X.send_full(number, keys, check[first], least, buckets))

    symbol_owners = X.answered(X.with_answers(chunks, shared, tell_symbols, X.MESSAGE), (0, X.first_owners))

    def tell_windows(number: int, chunk: Chunk, got: dict) -> pa.Table:
        words, bounds = parse(chunk)
        at, of = windows(bounds, width), owner(bounds)
        bits, entries, spans = X.unpacked(X.from_itself(got))
        open_ = np.unpackbits(np.frombuffer(bits, np.uint8), count=at.size).astype(bool)
        keys, least = X.unpress(entries, "<u8", "<i8")
        begin, end, place = X.unpress(spans, "<i4", "<i4", "<i4")
        gone = np.zeros(words.size, bool)
        if begin.size:
            # Symbols that a smaller id has are repeats as a whole.
            found = improved(least, keys, got, buckets)[place] < chunk.ids[of[begin]]
            begin, end = begin[found].astype(np.int64), end[found].astype(np.int64)
            gone = cover(begin, end, words.size)
            open_ &= ~cover(begin, end - width + 1, words.size)[at]
        sent = [X.to_itself(number, X.packed(np.packbits(open_), np.packbits(gone)))]
        if open_.any():
            keys, check, least, _ = named(words, at[open_], chunk.ids[of[at[open_]]], width)
            sent += X.send_full(number, keys, check, least, buckets)
        return X.messages(sent)

    owners = X.answered(X.with_answers(chunks, symbol_owners, tell_windows, X.MESSAGE), (0, X.first_owners))
    carried = rows.columns if carry else ["id"]
    schema = ", ".join([f"{c} {t}" for c, t in rows.dtypes if c in carried]
                       + ["n_words long, n_removed long, kept string",
                          "removed array<struct<start:int,end:int>>"])

    def remove(number: int, chunk: Chunk, got: dict) -> pa.Table:
        words, bounds = parse(chunk)
        at = windows(bounds, width)
        bits, by_symbols = X.unpacked(X.from_itself(got))
        gone = np.unpackbits(np.frombuffer(by_symbols, np.uint8), count=words.size).astype(bool)
        at = at[np.unpackbits(np.frombuffer(bits, np.uint8), count=at.size).astype(bool)]
        if at.size:
            ids = chunk.ids[owner(bounds)[at]]
            keys, _, least, place = named(words, at, ids, width)
            hit = at[improved(least, keys, got, buckets)[place] < ids]
            gone |= cover(hit, hit + width, words.size)
        begin, end = runs(gone, bounds)
        n_removed = counts_in(gone, bounds)
        kept = []
        for text, a, b, lost in zip(chunk.texts(), bounds, bounds[1:], n_removed):
            parts = text.split()
            kept.append(b" ".join(compress(parts, (~gone[a:b]).tolist()) if lost else parts))
        of = np.searchsorted(bounds, begin, "right") - 1
        spans = pa.StructArray.from_arrays(
            [pa.array(begin - bounds[of], pa.int32()), pa.array(end - bounds[of], pa.int32())], ["start", "end"])
        offsets = np.searchsorted(begin, bounds).astype(np.int32)
        return pa.table(
            [chunk.table.column(c) for c in carried]
            + [pa.array(np.diff(bounds)), pa.array(n_removed),
               pa.array(kept, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(offsets, spans)],
            [*carried, "n_words", "n_removed", "kept", "removed"])

    return X.with_answers(chunks, owners, remove, schema)


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """The documents with all their columns; texts that lost words are the words left,
    joined by a space, other texts are unchanged."""
    rows = remove_repeats(docs, id_col, text_col, width, carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return external(rows.withColumn("text", text), docs.columns, id_col, text_col)
