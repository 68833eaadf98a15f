"""Byte dedup by column-wise sorting of many documents.

Equal strings of ``width`` bytes are found in three steps.

1. Anchors. In each string the ``GRAM``-byte part with the smallest hash is its anchor;
   equal strings have equal anchors at equal places. Chunks send their anchors to
   buckets, which say which occur more than once (packed exchange, see ``exchange``).
   Strings whose anchor is unique are unique.
2. Column-wise construction. Strings around one occurrence of a shared anchor form a
   segment of at most 2 * width - GRAM bytes. A bucket gets each distinct segment of its
   anchors once per chunk, aligned at the anchor, and works on them as a collection of
   documents: each round inserts one symbol per document, from the last column to the
   first, and updates the sorted order of the suffixes that start at that column, the
   Burrows-Wheeler transform (the symbols in that order) and the common prefixes of
   neighbours. Symbols are in a file with one row per column, read in sequence; transform
   and prefixes pass from round to round through another.
   After the round of a column, neighbours with a common prefix of ``width`` or more start
   equal strings, and the smallest id of each such class goes back.
3. Each document drops the bytes covered by strings that a smaller id has, or that it has
   itself at an earlier start (the same construction, per document and anchor).

Hashes only say what to compare: a chunk sends segments that a hash calls equal once, and a
bucket takes such ones of several chunks together, after their bytes have been compared.

An anchor that more than ``HOT`` chunks have would gather a corpus in one bucket. There each
string is its own anchor, so that they go to as many buckets as there are strings, once per
chunk, and are worked on in the same way.

Defined results: a null or empty text has no bytes; a text of any length is handled, in one
task, with some 60 bytes of memory per byte of text; texts shorter than ``width`` lose
none; a null id counts as larger than every other; rows with one id never remove bytes
from each other; an empty table gives no rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from touchline.llm import exchange as X
from touchline.llm.shared import (
    NO_ID, Chunk, Spans, blob, buckets_for, by_bucket, counts_in, cover, internal, mix, owner, runs, stage_chunks)

WIDTH, GRAM = 100, 32
BUCKET_BYTES = 16 << 20
#: Chunks with an anchor (two megabytes each) beyond which its strings are their own anchors.
HOT = 512


def sliding_min(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest of each ``width`` consecutive values and the first place that has it, by
    doubling."""
    out, at, have = values, np.arange(values.size, dtype=np.int32), 1
    while have < width:
        more = min(have, width - have)
        right = out[more:] < out[:-more]
        at = np.where(right, at[more:], at[:-more])
        out = np.minimum(out[more:], out[:-more])
        have += more
    return out, at


def starts_of(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``first`` and have ``many`` places."""
    out = np.repeat((first - np.cumsum(many) + many).astype(np.int32), many)
    out += np.arange(out.size, dtype=np.int32)
    return out


class Anchors:
    """The anchors of a chunk's strings, and the segments around their occurrences."""

    def __init__(self, chunk: Chunk, width: int):
        data, starts = chunk.data, chunk.starts
        n, span = data.size, width - GRAM + 1
        first = np.minimum(starts[:-1], starts[1:] - width + 1)
        many = np.maximum(starts[1:] - width + 1 - starts[:-1], 0)
        at = starts_of(first, many)  # starts of all strings
        if not at.size:
            self.key = np.zeros(0, np.uint64)
            self.place = self.low = self.high = self.doc = np.zeros(0, np.int64)
            return
        self.spans = Spans(data)
        # Half of a hash is enough to choose by: equal strings choose alike.
        hashes = np.empty(n - GRAM + 1, np.uint32)
        for k in range(0, hashes.size, 1 << 18):
            grams = np.arange(k, min(k + (1 << 18), hashes.size))
            hashes[k:k + grams.size] = self.spans.of(grams, grams + GRAM) >> np.uint64(32)
        place = sliding_min(hashes, span)[1][at]  # of the string that starts at each place
        del hashes
        # Strings in a row share an occurrence until a smaller one comes or it falls out.
        new = np.ones(at.size, bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        run = np.flatnonzero(new)
        stop = np.append(run[1:], at.size)
        self.place, self.low, self.high = place[run].astype(np.int64), at[run].astype(np.int64), at[stop - 1].astype(np.int64)
        self.key = mix(self.spans.of(self.place, self.place + GRAM), 61)
        self.doc = np.searchsorted(starts, self.low, "right") - 1


class Strings:
    """The strings of some anchors, each as its own anchor."""

    def __init__(self, found: Anchors, chosen: np.ndarray, width: int):
        low, many = found.low[chosen], found.high[chosen] - found.low[chosen] + 1
        self.at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        self.place = self.low = self.high = self.at
        self.doc = np.repeat(found.doc[chosen], many)
        self.spans = found.spans
        self.key = mix(found.spans.of(self.at, self.at + width), 62)


class Segments:
    """Bytes around occurrences of anchors: ``begin`` to ``end`` of ``data``, ``before`` of
    them before the anchor. A string starts at each of the first end - begin - width + 1."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, before: np.ndarray):
        self.data, self.begin, self.end, self.before = data, begin, end, before.astype(np.int64)

    def alike(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether segments (of equal sizes) have the same bytes, column by column."""
        out = np.ones(one.size, bool)
        begin, size, to = self.begin[one], (self.end - self.begin)[one], self.begin[other]
        for column in range(int(size.max(initial=0))):
            at = np.minimum(column, size - 1)
            out &= self.data[begin + at] == self.data[to + at]
        return out


def distinct(order: np.ndarray, same: np.ndarray, seg: Segments) -> np.ndarray:
    """Which segments, in their order, are the first of their class: those that hashes call
    the ``same`` as the one before are compared, byte by byte, with the first of them."""
    new = np.ones(order.size, bool)
    new[1:] = ~same
    lead = order[np.maximum.accumulate(np.where(new, np.arange(order.size), 0))]
    again = np.flatnonzero(~new)
    new[again[~seg.alike(order[again], lead[again])]] = True
    return new


def equal_strings(group: np.ndarray, seg: Segments, width: int) -> Iterator[tuple]:
    """Column-wise construction over segments that are aligned at their anchors.

    Segments of one group are compared. After the round of a column with strings, yields
    how far before the anchor it is, the segments with a string there in sorted order, and
    the number of each one's class of equal strings.
    """
    m = group.size
    if not m:
        return
    reach = int(seg.before.max())
    tail = int((seg.end - seg.begin - seg.before).max())
    last_string = seg.before - (seg.end - seg.begin - width)  # before the anchor
    order = np.argsort(group, kind="stable")
    border = np.ones(m, bool)
    border[1:] = group[order][1:] != group[order][:-1]
    block = np.cumsum(border) * 512  # rounds move rows inside their groups only
    columns = np.arange(tail - 1, -reach - 1, -1)
    with tempfile.TemporaryFile() as file, tempfile.TemporaryFile() as rounds:
        step = max(1, (4 << 20) // m)
        for at in range(0, columns.size, step):
            place = (seg.begin + seg.before)[None, :] + columns[at:at + step, None]
            inside = (place >= seg.begin[None, :]) & (place < seg.end[None, :])
            symbols = seg.data[np.clip(place, 0, seg.data.size - 1)].astype(np.int16) + 1
            file.write(np.where(inside, symbols, 0).astype("<i2").tobytes())
        file.seek(0)
        rounds.write(bytes(4 * m))
        for column in columns.tolist():
            rounds.seek(0)
            common = np.frombuffer(rounds.read(4 * m), "<i4")  # with the one before in the order
            # What stands before the sorted suffixes: the transform's symbols of this column.
            symbol = np.frombuffer(file.read(2 * m), "<i2")[order]
            key = block + symbol
            by = np.argsort(key, kind="stable")
            key = key[by]
            at = np.flatnonzero((key[1:] == key[:-1]) & (symbol[by][1:] > 0)) + 1
            # One symbol more than the least common prefix of those that were between.
            fresh = np.zeros(m, np.int32)
            if at.size:
                fresh[at] = 1 + _least_between(common, by[at - 1] + 1, by[at])
            order = order[by]
            rounds.seek(0)
            rounds.write(fresh.tobytes())
            rounds.write(symbol[by].tobytes())
            if column <= 0:
                here = (seg.before[order] >= -column) & (last_string[order] <= -column)
                if here.any():
                    yield -column, order[here], np.cumsum(fresh < width)[here]


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of values[low..high], both included."""
    width = high - low + 1
    out = values[high].copy()
    far = np.flatnonzero(width > 1)
    if far.size:
        table, level = [values], 0
        need = int(width[far].max())
        while (2 << level) <= need:
            last = table[-1]
            table.append(np.minimum(last[:-(1 << level)], last[1 << level:]))
            level += 1
        k = np.frexp(width[far])[1] - 1
        for level in np.unique(k).tolist():
            own = far[k == level]
            out[own] = np.minimum(table[level][low[own]], table[level][high[own] - (1 << level) + 1])
    return out


def first_in_class(number: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For members of classes (numbers ascending) the smallest value of their class."""
    cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return np.repeat(np.minimum.reduceat(value, cuts), np.diff(np.append(cuts, number.size)))


# --- what a chunk sends, what a bucket answers, what a chunk does with it -----------------

_HEAD = np.dtype([("key", "<u8"), ("print", "<u8"), ("least", "<i8"), ("size", "u1"), ("before", "u1")])
#: An entry's strings from ``far`` to ``near`` bytes before its anchor are in ``least``, too.
_ANSWER = np.dtype([("entry", "<i4"), ("far", "u1"), ("near", "u1"), ("least", "<i8")])


class Entries:
    """Distinct segments of a chunk, sorted by their anchors' keys."""

    def __init__(self, chunk: Chunk, found: Anchors, chosen: np.ndarray, width: int):
        self.chosen = chosen
        begin, end = found.low[chosen], found.high[chosen] + width
        before = found.place[chosen] - begin
        self.segments = Segments(chunk.data, begin, end, before)
        shape = (before * 256 + end - begin).astype(np.uint64)
        prints = mix(found.spans.of(begin, end) ^ mix(shape, 63), 64)
        keys = found.key[chosen]
        order = np.lexsort((prints, keys))
        new = distinct(order, (prints[order][1:] == prints[order][:-1]) & (keys[order][1:] == keys[order][:-1]),
                       self.segments)
        self.first = order[new]
        self.place = np.empty(order.size, np.int64)  # entry of each segment
        self.place[order] = np.cumsum(new) - 1
        self.head = np.zeros(self.first.size, _HEAD)
        least = np.full(self.first.size, NO_ID)
        np.minimum.at(least, self.place, chunk.ids[found.doc[chosen]])
        for name, values in (("key", keys), ("print", prints), ("size", end - begin), ("before", before)):
            self.head[name] = values[self.first]
        self.head["least"] = least

    def buckets(self, n: int) -> Iterator[tuple[int, slice]]:
        return by_bucket(X.bucket_of(self.head["key"], n).astype(np.int64))

    def messages(self, number: int, n: int, shift: int = 0) -> list[tuple]:
        press = zstandard.ZstdCompressor(level=3).compress
        out = []
        for bucket, at in self.buckets(n):
            own = self.first[at]
            parts = [self.segments.data[a:b] for a, b in zip(
                self.segments.begin[own].tolist(), self.segments.end[own].tolist())]
            out.append((bucket + shift, number, press(blob(self.head[at])), press(blob(np.concatenate(parts)))))
        return out


def solve(width: int):
    """A bucket's work: the smallest ids of all strings of its segments."""

    def answer(table: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor().decompress
        heads = [np.frombuffer(unpress(x), _HEAD) for x in table.column("keys").to_pylist()]
        data = np.frombuffer(b"".join(unpress(x) for x in table.column("vals").to_pylist()), np.uint8)
        sizes = [h.size for h in heads]
        head = np.concatenate(heads)
        end = np.cumsum(head["size"].astype(np.int64))
        # Equal segments are one; a smaller id that has it has all of its strings.
        order = np.lexsort((head["least"], head["print"], head["key"]))
        size, before = head["size"].astype(np.int64), head["before"].astype(np.int64)
        every = Segments(data, end - size, end, before)
        new = distinct(order, (head["print"][order][1:] == head["print"][order][:-1])
                       & (head["key"][order][1:] == head["key"][order][:-1]), every)
        lead = order[new]
        of = np.empty(order.size, np.int64)
        of[order] = np.cumsum(new) - 1
        least = head["least"][lead]
        better = np.flatnonzero(least[of] < head["least"])
        out = [np.zeros(better.size, _ANSWER)]
        out[0]["entry"], out[0]["least"] = better, least[of[better]]
        out[0]["far"], out[0]["near"] = before[better], before[better] - size[better] + width
        # Anchors with several segments: the column-wise construction.
        keys, group, count = np.unique(head["key"][lead], return_inverse=True, return_counts=True)
        several = np.flatnonzero(count[group] > 1)
        own = lead[several]
        seg = Segments(data, end[own] - size[own], end[own], before[own])
        rows, aheads, ids = [], [], []
        for ahead, who, number in equal_strings(group[several], seg, width):
            low = first_in_class(number, least[several][who])
            hit = np.flatnonzero(low < least[several][who])
            rows.append(several[who[hit]])
            aheads.append(np.full(hit.size, ahead))
            ids.append(low[hit])
        if rows and sum(x.size for x in rows):
            row, ahead, low = (np.concatenate(x) for x in (rows, aheads, ids))
            by = np.lexsort((ahead, low, row))
            row, ahead, low = row[by], ahead[by], low[by]
            cut = np.ones(row.size, bool)
            cut[1:] = (row[1:] != row[:-1]) | (low[1:] != low[:-1]) | (ahead[1:] != ahead[:-1] + 1)
            start = np.flatnonzero(cut)
            stop = np.append(start[1:], row.size) - 1
            # Every entry that holds the segment gets its spans.
            members = np.argsort(of, kind="stable")
            first = np.searchsorted(of[members], row[start])
            many = np.searchsorted(of[members], row[start], "right") - first
            span = np.repeat(np.arange(start.size), many)
            inner = np.arange(span.size) - np.repeat(np.cumsum(many) - many, many)
            part = np.zeros(span.size, _ANSWER)
            part["entry"] = members[first[span] + inner]
            part["far"], part["near"] = ahead[stop][span], ahead[start][span]
            part["least"] = low[start][span]
            out.append(part)
        answers = np.concatenate(out)
        answers = answers[np.argsort(answers["entry"], kind="stable")]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        cuts = np.searchsorted(answers["entry"], bounds)
        result = []
        for k, (b, c) in enumerate(zip(table.column("bucket").to_pylist(), table.column("chunk").to_pylist())):
            own = answers[cuts[k]:cuts[k + 1]].copy()
            if own.size:
                own["entry"] -= bounds[k]
                result.append((b, c, blob(own), b""))
        return X.messages(result)

    return answer


def repeats_inside(found: Anchors, chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans of string starts that their own document has earlier."""
    group = mix(found.key ^ mix(found.doc.astype(np.uint64), 71), 72)
    begin, end = found.low, found.high + width
    before = found.place - begin
    prints = mix(found.spans.of(begin, end) ^ mix((before * 256 + end - begin).astype(np.uint64), 73), 74)
    order = np.lexsort((begin, prints, group))
    new = distinct(order, (group[order][1:] == group[order][:-1]) & (prints[order][1:] == prints[order][:-1]),
                   Segments(chunk.data, begin, end, before))
    whole = order[~new]
    first = np.sort(order[new])
    _, number, count = np.unique(group[first], return_inverse=True, return_counts=True)
    own = first[count[number] > 1]
    starts, stops = [found.low[whole]], [found.high[whole] + 1]
    seg = Segments(chunk.data, begin[own], end[own], before[own])
    for ahead, who, class_ in equal_strings(group[own], seg, width):
        at = found.place[own[who]] - ahead
        later = at[at > first_in_class(class_, at)]
        starts.append(later)
        stops.append(later + 1)
    return np.concatenate(starts), np.concatenate(stops)


def removed_starts(chunk: Chunk, found: Anchors | Strings, chosen: np.ndarray, width: int, got: dict,
                   buckets: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans of string starts that a smaller id has, after the answers of the buckets that are
    numbered from ``shift``."""
    entries = Entries(chunk, found, chosen, width)
    ids = chunk.ids[found.doc[chosen]]
    members = np.argsort(entries.place, kind="stable")
    by_entry = entries.place[members]
    whole = entries.head["least"][entries.place] < ids
    starts, stops = [found.low[chosen[whole]]], [found.high[chosen[whole]] + 1]
    for bucket, at in entries.buckets(buckets):
        if bucket + shift not in got:
            continue
        answer = np.frombuffer(got[bucket + shift][0], _ANSWER)
        entry = answer["entry"] + at.start
        # The chunk's segments that each answer is about.
        low = np.searchsorted(by_entry, entry)
        many = np.searchsorted(by_entry, entry, "right") - low
        which = np.repeat(np.arange(entry.size), many)
        inner = np.arange(which.size) - np.repeat(np.cumsum(many) - many, many)
        own = members[low[which] + inner]
        hit = answer["least"][which] < ids[own]
        own, which = own[hit], which[hit]
        anchor = found.place[chosen[own]]
        starts.append(anchor - answer["far"][which])
        stops.append(anchor - answer["near"][which] + 1)
    return np.concatenate(starts), np.concatenate(stops)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   hot: int = HOT) -> DataFrame:
    """Per document id, n_bytes, n_removed, kept (the bytes left) and removed: the maximal
    removed runs as spans of bytes."""
    if not GRAM < width <= (255 + GRAM) // 2:
        raise ValueError("width has to be above the anchors' length and below 144")
    rows = internal(docs, id_col, text_col).select("id", "text")
    chunks = stage_chunks(rows, "bytes-chunks")
    buckets = buckets_for(chunks, BUCKET_BYTES)

    def small(found: Anchors):
        return np.unique(X.small_keys(found.key, buckets), return_inverse=True, return_counts=True)

    def ask(number: int, chunk: Chunk):
        keys, _, count = small(Anchors(chunk, width))
        return X.send_small(number, keys, count > 1)

    shared = X.shared_keys(X.each_chunk(chunks, ask), hot)

    def segments(number: int, chunk: Chunk, got: dict) -> pa.Table:
        found = Anchors(chunk, width)
        keys, place, _ = small(found)
        state = X.states(keys, got)
        each = state[place]
        sent = [X.to_itself(number, blob(state))]
        if (each == 1).any():
            sent += Entries(chunk, found, np.flatnonzero(each == 1), width).messages(number, buckets)
        if (each == 2).any():
            strings = Strings(found, np.flatnonzero(each == 2), width)
            sent += Entries(chunk, strings, np.arange(strings.at.size), width).messages(number, buckets, buckets)
        return X.messages(sent)

    owners = X.answered(X.with_answers(chunks, shared, segments, X.MESSAGE), (0, solve(width)))

    def remove(number: int, chunk: Chunk, got: dict) -> pa.Table:
        n, data, bounds = chunk.data.size, chunk.data, chunk.starts
        found = Anchors(chunk, width)
        gone = np.zeros(n, bool)
        if found.key.size:
            starts, stops = repeats_inside(found, chunk, width)
            keys, place, _ = small(found)
            each = np.frombuffer(X.from_itself(got), np.uint8)[place]
            parts = [(found, np.flatnonzero(each == 1), 0)]
            if (each == 2).any():
                strings = Strings(found, np.flatnonzero(each == 2), width)
                parts.append((strings, np.arange(strings.at.size), buckets))
            for own, chosen, shift in parts:
                if chosen.size:
                    more = removed_starts(chunk, own, chosen, width, got, buckets, shift)
                    starts, stops = (np.concatenate(x) for x in zip((starts, stops), more))
            gone = cover(starts, stops + width - 1, n)
        begin, end = runs(gone, bounds)
        kept_data = data[~gone].tobytes()
        n_removed = counts_in(gone, bounds)
        ends = np.cumsum(np.diff(bounds) - n_removed).tolist()
        of = np.searchsorted(bounds, begin, "right") - 1
        spans = pa.StructArray.from_arrays(
            [pa.array(begin - bounds[of], pa.int32()), pa.array(end - bounds[of], pa.int32())], ["start", "end"])
        return pa.table(
            [chunk.table.column("id"), pa.array(np.diff(bounds)), pa.array(n_removed),
             pa.array([kept_data[a:b] for a, b in zip([0, *ends], ends)], pa.binary()),
             pa.ListArray.from_arrays(np.searchsorted(begin, bounds).astype(np.int32), spans)],
            ["id", "n_bytes", "n_removed", "kept", "removed"])

    return X.with_answers(chunks, owners, remove, "id long, n_bytes long, n_removed long, kept binary, "
                          "removed array<struct<start:int,end:int>>")
