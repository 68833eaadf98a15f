"""Byte-level BPE with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary, one slot per token, resolves
pre-tokens that are tokens themselves with one probe and one comparison. Second tier: for
the others, bytes are a linked list, and a heap holds the joins that neighbours allow, by
rank and then from the left; stale entries are known by their ends. Decoding looks up each
id's bytes. Each worker remembers parts it has met (see ``tokens``).

Defined results: a null or empty text has no ids; null ids and repeated rows are handled
one by one; an empty table gives no rows. There is no exchange.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from touchline.llm.shared import internal, slices
from touchline.llm.tokens import Encoder, encode_with

_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[k] for k in range(len(ranks))]


def _slot(h: int, seed: int, n: int) -> int:
    h = ((h ^ seed * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9) & _MASK
    return (h ^ h >> 32) % n


class PerfectHash:
    """Minimal perfect hash by displacement: keys are dealt to small groups, and each
    group, the largest first, gets the first seed that sends its keys to free slots.
    Groups of one key name their slot directly."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.groups = max(1, n // 4)
        members: list[list[int]] = [[] for _ in range(self.groups)]
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for k, h in enumerate(hashes):
            members[h % self.groups].append(k)
        self.seeds, self.key_at = [0] * self.groups, [-1] * n
        order = sorted(range(self.groups), key=lambda g: -len(members[g]))
        free = n - 1
        for g in order:
            own = members[g]
            if len(own) > 1:
                seed = 1
                while True:
                    at = [_slot(hashes[k], seed, n) for k in own]
                    if len(set(at)) == len(at) and all(self.key_at[s] < 0 for s in at):
                        break
                    seed += 1
                self.seeds[g] = seed
                for k, s in zip(own, at):
                    self.key_at[s] = k
            elif own:
                while self.key_at[free] >= 0:
                    free -= 1
                self.seeds[g] = -free - 1
                self.key_at[free] = own[0]

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        seed = self.seeds[h % self.groups]
        return -seed - 1 if seed < 0 else _slot(h, seed, self.n)


class ByteBpe:
    """Encodes pre-tokens. ``tokens``: the vocabulary by rank; ``pattern`` splits text."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.pattern = pattern
        self.tokens = tokens
        self.hash = PerfectHash(tokens)
        self.by_slot = [tokens[k] for k in self.hash.key_at]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "ranks")}

    def prepare(self) -> None:
        import regex

        self.split = regex.compile(self.pattern).findall
        self.ranks = {t: k for k, t in enumerate(self.tokens)}

    def whole(self, piece: bytes) -> int | None:
        slot = self.hash.slot(piece)
        return self.hash.key_at[slot] if self.by_slot[slot] == piece else None

    def join_bytes(self, piece: bytes) -> list[int]:
        n, rank = len(piece), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # starts of the neighbours
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        gone = [False] * (n + 1)
        while heap:
            _, left, end = heapq.heappop(heap)
            middle = after[left]
            if gone[left] or middle >= n or after[middle] != end:
                continue
            gone[middle] = True
            after[left] = end
            if end < n:
                before[end] = left
                stop = after[end]
                if (r := rank(piece[left:stop])) is not None:
                    heapq.heappush(heap, (r, left, stop))
            start = before[left]
            if start >= 0 and (r := rank(piece[start:end])) is not None:
                heapq.heappush(heap, (r, start, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i:after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(text):
            raw = piece.encode()
            one = self.whole(raw)
            if one is None:
                out += self.join_bytes(raw)
            else:
                out.append(one)
        return out

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.encode(t) for t in texts]
        return (np.fromiter(chain.from_iterable(lists), np.uint32),
                np.fromiter(map(len, lists), np.int64, len(lists)))


class Decoder:
    """ids -> bytes, for many ids at once."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All bytes, and the place after each id's."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not ends.size:
            return b"", ends
        return self.data[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes(), ends


_workers: dict[int, tuple[Encoder, Decoder]] = {}


def _worker(model: ByteBpe) -> tuple[Encoder, Decoder]:
    key = hash((model.pattern, len(model.tokens), tuple(model.tokens[-50:])))
    if key not in _workers:
        model.prepare()
        _workers[key] = Encoder(model.encode_many, True), Decoder(model.tokens)
    return _workers[key]


def encode_decode(docs: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per document id, n_tokens, ids (little-endian 32-bit) and decoded (their bytes)."""
    rows = internal(docs, id_col, text_col).select("id", "text")
    # Some two megabytes, whatever the corpus: the vocabulary and its hash.
    model = rows.sparkSession.sparkContext.broadcast(ByteBpe(tokens, pattern))

    def run(batches):
        encoder, decoder = _worker(model.value)
        for block in slices(batches, 1 << 20):
            texts = [t or "" for t in block.column("text").to_pylist()]
            ids, bounds = encode_with(encoder, texts)
            data, ends = decoder.decode(ids)
            places = np.concatenate([[0], ends])[bounds].tolist()
            raw, at = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(np.diff(bounds)),
                 pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary()),
                 pa.array([data[a:b] for a, b in zip(places, places[1:])], pa.binary())],
                ["id", "n_tokens", "ids", "decoded"])

    return rows.mapInArrow(run, "id long, n_tokens long, ids binary, decoded binary")
