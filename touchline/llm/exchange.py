"""Packed exchanges between chunks: which keys are shared, and who has them first.

A chunk sends each bucket one message: its sorted distinct keys. A bucket joins the
messages of all chunks and answers each of them. A key that is everywhere is in a message
once per chunk, so the most frequent key of a corpus costs one entry per two megabytes of
text, and buckets hold a fixed amount of text each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from touchline.llm.shared import blob, bucket_of, by_bucket, read_chunk

MESSAGE = "bucket long, chunk long, keys binary, vals binary"
#: The bucket of what a chunk tells itself, as it comes back.
OWN = -1


def to_itself(chunk: int, data: bytes) -> tuple:
    """A message that comes back unchanged: a bucket of its own."""
    return (-1 - chunk, chunk, zstandard.compress(data, 3), b"")


def from_itself(got: dict) -> bytes:
    return zstandard.decompress(got[OWN][0])


def packed(*parts: bytes | np.ndarray) -> bytes:
    """Parts of one message to itself."""
    parts = [p if isinstance(p, bytes) else blob(p) for p in parts]
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def unpacked(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data[:8], "<i8")[0])
    ends = np.cumsum([8 * (n + 1), *np.frombuffer(data[8:8 * (n + 1)], "<i8")]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def messages(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table({
        "bucket": pa.array(cols[0], pa.int64()), "chunk": pa.array(cols[1], pa.int64()),
        "keys": pa.array(cols[2], pa.binary()), "vals": pa.array(cols[3], pa.binary())})


def small_keys(keys: np.ndarray, n: int) -> np.ndarray:
    """Keys cut to a bucket and 32 bits; a clash makes a key look shared, no more."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    return (bucket << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def send_small(chunk: int, keys: np.ndarray, several: np.ndarray) -> list[tuple]:
    """Messages of sorted small keys; ``several``: the chunk alone makes the key shared."""
    return [(b, chunk, blob(keys[at].astype(np.uint32)), blob(np.packbits(several[at])))
            for b, at in by_bucket((keys >> np.uint64(32)).astype(np.int64))]


def shared_keys(sent: DataFrame, hot: int = 0) -> DataFrame:
    """Answers to ``send_small``: per key a byte, 1 if it is shared, 2 if more than
    ``hot`` chunks have it (0: never)."""

    def answer(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
        sizes = [x.size for x in lists]
        flags = np.concatenate([np.unpackbits(np.frombuffer(v, np.uint8), count=n) for v, n in
                                zip(table.column("vals").to_pylist(), sizes)])
        _, place, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        weight = np.bincount(place, weights=flags) + count
        state = (weight >= 2).astype(np.uint8)
        if hot:
            state[count > hot] = 2
        each = np.split(state[place], np.cumsum(sizes)[:-1])
        return messages([(b, c, zstandard.compress(blob(s), 3), b"") for b, c, s in zip(
            table.column("bucket").to_pylist(), table.column("chunk").to_pylist(), each)])

    return sent.groupBy("bucket").applyInArrow(answer, MESSAGE)


def states(keys: np.ndarray, got: dict) -> np.ndarray:
    """The answered byte of each of a chunk's small keys."""
    out = np.zeros(keys.size, np.uint8)
    for bucket, at in by_bucket((keys >> np.uint64(32)).astype(np.int64)):
        out[at] = np.frombuffer(zstandard.decompress(got[bucket][0]), np.uint8)
    return out


def press(*columns: np.ndarray) -> bytes:
    """Columns of one length, compressed byte plane by byte plane: sorted keys and ids
    that repeat take less room that way."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(c.size, c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.compress(b"".join(planes), 3)


def unpress(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = raw.size // sum(widths), 0, []
    for kind, width in zip(kinds, widths):
        out.append(np.ascontiguousarray(raw[at:at + n * width].reshape(width, n).T).view(kind).reshape(-1))
        at += n * width
    return out


def send_full(chunk: int, keys: np.ndarray, checks: np.ndarray, least: np.ndarray, n: int,
              shift: int = 0) -> list[tuple]:
    """Messages of sorted distinct keys (64 bits and a check of 32) with the smallest id
    that has each, to buckets numbered from ``shift``."""
    return [(b + shift, chunk, press(keys[at], checks[at], least[at]), b"")
            for b, at in by_bucket(bucket_of(keys, n).astype(np.int64))]


def first_owners(table: pa.Table) -> pa.Table:
    """A bucket's answers to ``send_full``: the entries whose key a smaller id has."""
    lists = [unpress(x, "<u8", "<u4", "<i8") for x in table.column("keys").to_pylist()]
    key, check, least = (np.concatenate(x) for x in zip(*lists))
    order = np.lexsort((least, check, key))
    new = np.ones(key.size, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    found = np.empty(key.size, np.int64)
    found[order] = least[order][np.maximum.accumulate(np.where(new, np.arange(key.size), 0))]
    rows, at = [], 0
    for b, c, (own, _, _) in zip(table.column("bucket").to_pylist(), table.column("chunk").to_pylist(), lists):
        here = slice(at, at + own.size)
        better = np.flatnonzero(found[here] < least[here])
        if better.size:
            rows.append((b, c, press(better.astype("<i4"), found[here][better]), b""))
        at += own.size
    return messages(rows)


def better_owners(message: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The entries that an answer of ``first_owners`` is about, and their smaller ids."""
    entry, ids = unpress(message, "<i4", "<i8")
    return entry, ids


def answered(sent: DataFrame, *answers: tuple[int, Callable[[pa.Table], pa.Table]]) -> DataFrame:
    """Let buckets answer; ``answers``: from which bucket on which function does it."""

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return table.set_column(0, "bucket", pa.array([OWN] * table.num_rows, pa.int64()))
        return next(f for low, f in reversed(answers) if bucket >= low)(table)

    return sent.groupBy("bucket").applyInArrow(answer, MESSAGE)


def with_answers(chunks: DataFrame, answers: DataFrame, use: Callable, schema: str) -> DataFrame:
    """Call ``use(number, chunk, {bucket: (keys, vals)})`` where each chunk is."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {b: (k, v) for b, k, v in zip(*(right.column(c).to_pylist() for c in ("bucket", "keys", "vals")))}
        return pa.concat_tables([use(number, read_chunk(payload), got) for number, payload in zip(
            left.column("chunk").to_pylist(), left.column("payload").to_pylist())])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(meet, schema)


def each_chunk(chunks: DataFrame, make: Callable) -> DataFrame:
    """Messages made from every chunk."""

    def run(batches):
        for batch in batches:
            for number, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload").to_pylist()):
                yield from messages(make(number, read_chunk(payload))).to_batches()

    return chunks.select("chunk", "payload").mapInArrow(run, MESSAGE)


__all__ = ["MESSAGE", "OWN", "answered", "better_owners", "each_chunk", "first_owners", "from_itself",
           "messages", "packed", "press", "send_full", "send_small", "shared_keys", "small_keys", "states",
           "to_itself", "unpacked", "unpress", "with_answers"]
