"""Best-fit packing of token sequences by bin completion.

Documents become pieces of at most ``capacity`` tokens. How pieces fill sequences depends
on their lengths alone, so the search works on the number of pieces of each length, a
table of at most ``capacity`` rows whatever the size of the corpus. It repeats: take the
largest length left, enumerate all undominated fillings of the room beside it, and use one
of them some number of times. Branches are cut by their waste: a filling may leave no more
room than sequences fewer than the incumbent's have in all. Best-fit decreasing gives the
first incumbent, best fit from inside the search gives others, and the search ends at once
when an incumbent meets the lower bound. ``nodes`` bounds the search, not the data: when
it runs out the incumbent stands, a packing of all pieces.

The plan says which length sits where in how many like sequences. Pieces of one length
are interchangeable, so each is dealt a place by its rank among those of its length. Ranks
come from counts by (file part, length); no sequence or length gathers in one task.

Defined results: a null or empty text is one piece of the end id alone; null ids are kept;
repeated rows are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.shared import internal, materialize, slices
from touchline.llm.tokens import encode_texts

CAPACITY, END_ID = 2048, 0
#: Steps of the search: branches that are opened, and steps of enumerating fillings.
NODES = 200_000

PIECE_SCHEMA = ("id long, piece int, start long, length long, ids binary, part int, rank long")


# --- the plan, on counts by length ------------------------------------------------------

def lower_bound(counts: Counter, capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by lengths over half, which
    can't share (the best of the bounds over all thresholds for small lengths)."""
    total = sum(n * k for n, k in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for small in [0, *[n for n in lengths if n <= capacity // 2]]:
        alone = sum(k for n, k in counts.items() if n > capacity - small)
        half = sum(k for n, k in counts.items() if capacity // 2 < n <= capacity - small)
        room = half * capacity - sum(n * k for n, k in counts.items() if capacity // 2 < n <= capacity - small)
        rest = sum(n * k for n, k in counts.items() if small <= n <= capacity // 2)
        best = max(best, alone + half + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing: each length, the largest first, goes to the fullest sequences
    it fits; like sequences are handled together."""
    open_: dict[int, Counter] = {}
    closed: Counter = Counter()
    rooms: list[int] = []

    def put(filling, room, k):
        if room == 0:
            closed[filling] += k
            return
        if room not in open_:
            open_[room] = Counter()
            insort(rooms, room)
        open_[room][filling] += k

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, odd = divmod(left, each)
                if full:
                    put((length,) * each, capacity - each * length, full)
                if odd:
                    put((length,) * odd, capacity - odd * length, 1)
                left = 0
                continue
            room = rooms[at]
            filling, have = next(iter(open_[room].items()))
            more = room // length
            if left >= more and more > 1:
                k = min(have, left // more)
                step = more
            else:
                k, step = min(have, left), 1
            open_[room][filling] -= k
            if not open_[room][filling]:
                del open_[room][filling]
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            put(filling + (length,) * step, room - step * length, k)
            left -= k * step
    return [*closed.items(), *[(f, k) for group in open_.values() for f, k in group.items()]]


def reachable(lengths: list[int], counts: Counter, room: int) -> list[int]:
    """For each place in ``lengths`` the totals up to ``room`` that parts from there on can
    make, as the bits of a number."""
    out, whole = [1], (1 << (room + 1)) - 1
    for n in reversed(lengths):
        bits, left, step = out[-1], min(counts[n], room // n), 1
        while left:  # 1, 2, 4, ... parts at once, then the rest
            k = min(step, left)
            bits |= bits << (n * k) & whole
            left, step = left - k, step * 2
        out.append(bits)
    return out[::-1]


def fillings(counts: Counter, room: int, waste: int, budget: list[int]):
    """(waste, parts) of the undominated fillings of a room that leave at most ``waste``, the
    fullest first, and among those as full the ones with the largest parts first. Each step
    of the enumeration takes one from ``budget[0]``; it ends when that is used up.

    A filling is dominated, and left out, when one of its parts could be swapped for a larger
    one, or two for one that is as long or longer, within the space it leaves.
    """
    lengths = sorted((n for n, k in counts.items() if k and n <= room), reverse=True)
    reach = reachable(lengths, counts, room)
    rising = lengths[::-1]

    def free(low: int, high: int, own: Counter, without=()) -> bool:
        """Whether a part of a length in low..high is left."""
        for m in rising[bisect_left(rising, low):bisect_right(rising, high)]:
            if counts[m] - own[m] + without.count(m) > 0:
                return True
        return False

    def dominated(filling: tuple[int, ...], spare: int) -> bool:
        own = Counter(filling)
        if spare and any(free(n + 1, n + spare, own) for n in own):
            return True
        parts = list(own)
        return any(free(a + b, a + b + spare, own) for i, a in enumerate(parts) for b in parts[i:]
                   if a != b or own[a] > 1)

    def exact(k: int, left: int, chosen: list[int]):
        if not left:
            yield tuple(chosen)
            return
        while k < len(lengths) and budget[0] > 0 and reach[k] >> left & 1:
            budget[0] -= 1
            n = lengths[k]
            if n <= left and counts[n] > chosen.count(n):
                chosen.append(n)
                yield from exact(k, left - n, chosen)
                chosen.pop()
            k += 1

    for spare in range(min(waste, room) + 1):
        if budget[0] <= 0:
            return
        for filling in exact(0, room - spare, []):
            if not dominated(filling, spare):
                yield spare, filling


def complete(counts: Counter, capacity: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fillings with how often each is used: as few sequences as the search finds.

    A branch takes the largest length left, one of all undominated fillings around it, and
    one number of times to use it, the most first; fillings of one length are taken in their
    order, so no plan is met twice. Without the limit of ``nodes`` the search is complete.
    """
    counts = Counter({n: k for n, k in counts.items() if k})
    if not counts:
        return []
    fewest = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    size = sum(k for _, k in best)
    budget = [nodes]

    def branches(left: Counter, used: int, length: int, after):
        """Children of a node: (filling with its largest, times, key for the order)."""
        largest = max(left)
        rest = left.copy()
        rest[largest] -= 1
        allowed = (size - 1 - used) * capacity - length  # waste that still beats the incumbent
        if allowed < 0:
            return
        for spare, filling in fillings(rest, capacity - largest, allowed, budget):
            key = (largest, spare, tuple(-n for n in filling))
            if after is not None and after[0] == largest and key <= after:
                continue
            own = Counter((largest, *filling))
            most = min(left[n] // k for n, k in own.items())
            for times in range(most, 0, -1):
                if spare * times <= (size - 1 - used) * capacity - length:
                    yield (largest, *filling), times, key

    def beaten(plan) -> list:
        out = []
        while plan:
            plan, step = plan
            out.append(step)
        return out

    total = sum(n * k for n, k in counts.items())
    stack = [(counts, 0, total, None, branches(counts, 0, total, None))]
    visited = 0
    while stack and size > fewest and budget[0] > 0:
        left, used, length, plan, children = stack[-1]
        step = next(children, None)
        if step is None:
            stack.pop()
            continue
        budget[0] -= 1
        filling, times, key = step
        after = left.copy()
        for n in filling:
            after[n] -= times
        after = Counter({n: k for n, k in after.items() if k})
        now, rest, trail = used + times, length - sum(filling) * times, (plan, (filling, times))
        if now + -(-rest // capacity) >= size:
            continue
        if not after:
            best, size = beaten(trail), now
            continue
        visited += 1
        if visited % 20 == 1:  # best fit from here may already be better
            tail = best_fit(after, capacity)
            found = now + sum(k for _, k in tail)
            if found < size:
                best, size = beaten(trail) + tail, found
                continue
        stack.append((after, now, rest, trail, branches(after, now, rest, key)))
    return best


def places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): ranks of a length in order."""
    out, rank, sequence = [], Counter(), 0
    for filling, times in plan:
        offset = 0
        for n in filling:
            out.append((n, rank[n], times, sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    return out


# --- Spark ------------------------------------------------------------------------------

def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int = CAPACITY,
           end_id: int = END_ID) -> DataFrame:
    """Each document's ids with the end id, cut where it is longer than the capacity.

    Only the first piece may be shorter. ``part`` and ``rank`` number the pieces of one
    length inside a partition.
    """
    rows = internal(docs, id_col, text_col).select("id", "text")

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for block in slices(batches, 1 << 20):
            texts = [t or "" for t in block.column("text").to_pylist()]
            ids, bounds = encode_texts(texts, path, True)
            bounds = bounds.tolist()
            out = {c: [] for c in ("id", "piece", "start", "length", "ids", "rank")}
            for doc, a, b in zip(block.column("id").to_pylist(), bounds, bounds[1:]):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                at, number = 0, 0
                first = own.size % capacity or capacity
                while at < own.size:
                    size = capacity if at else first
                    out["id"].append(doc)
                    out["piece"].append(number)
                    out["start"].append(at)
                    out["length"].append(size)
                    out["ids"].append(own[at:at + size].tobytes())
                    out["rank"].append(int(seen[size]))
                    seen[size] += 1
                    at, number = at + size, number + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["id"], pa.int64()), pa.array(out["piece"], pa.int32()),
                 pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()),
                 pa.array(out["ids"], pa.binary()),
                 pa.array([part] * len(out["id"]), pa.int32()), pa.array(out["rank"], pa.int64())],
                ["id", "piece", "start", "length", "ids", "part", "rank"])

    return rows.mapInArrow(cut, PIECE_SCHEMA)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *,
         capacity: int = CAPACITY, end_id: int = END_ID, nodes: int = NODES) -> DataFrame:
    """Per piece: id, piece, start, length, ids (little-endian 32-bit), ids_crc32,
    sequence_id and offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, id_col, text_col, path, capacity, end_id).withColumn(
        "ids_crc32", F.crc32("ids")), "pack-pieces")
    by_part = cut.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    # At most `capacity` rows, whatever the size of the corpus.
    counts = Counter({r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()})
    seats: dict[int, list] = {}
    for n, *seat in places(complete(counts, capacity, nodes)):
        seats.setdefault(n, []).append(seat)
    table = {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in seats.items()}
    ranked = cut.join(offsets, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def seat(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for own in np.split(order, cuts) if len(order) else []:
            first, _, start, place = table[int(length[own[0]])]
            k = np.searchsorted(first, rank[own], "right") - 1
            sequence[own] = start[k] + rank[own] - first[k]
            offset[own] = place[k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("seat", seat("length", "rank"))
    return placed.select("id", "piece", "start", "length", "ids", "ids_crc32",
                         "seat.sequence_id", "seat.offset")
