"""What the operators here share: scratch tables, chunks of documents, hashing in numpy.

A *chunk* is a row that holds some two megabytes of whole documents as one compressed
Arrow stream. Operators that have to come back to a document after an exchange write
chunks once: the chunk's number is then a stable address, and what crosses the network
per chunk is a few packed arrays instead of a row for each word.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.scratch import materialize, scratch_path

#: Text bytes in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Stands for a doc_id that is null: larger than every other.
NO_ID = np.iinfo(np.int64).max
CHUNK_SCHEMA = "chunk long, n_bytes long, payload binary"

__all__ = ["materialize", "scratch_path", "internal", "stage_chunks", "read_chunk", "mix"]


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application: Python workers import the
    operators' modules, and need not be started where the package is installed."""
    context = spark.sparkContext
    if getattr(context, "_touchline_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="touchline-code-")) / "touchline_package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for module in sorted(root.rglob("*.py")):
            out.write(module, module.relative_to(root.parent))
    context.addPyFile(str(path))
    context._touchline_shipped = True


def internal(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``id``, ``text`` and, when there are others, ``rest``: a struct of all
    other columns, so that no name of theirs can meet a name used here."""
    ship_package(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    quoted = lambda c: F.col(f"`{c}`")
    columns = [quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text")]
    if rest:
        columns.append(F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("rest"))
    return docs.select(*columns)


def external(frame: DataFrame, columns: list[str], id_col: str, text_col: str, text: str = "text") -> DataFrame:
    """The reverse of ``internal``, with the column ``text`` as the new text."""
    rest = [c for c in columns if c not in (id_col, text_col)]
    place = {c: f"rest.c{i}" for i, c in enumerate(rest)} | {id_col: "id", text_col: text}
    return frame.select(*[F.col(place[c]).alias(c) for c in columns])


def slices(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about ``size`` bytes of text, or one document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column("text").cast(pa.large_binary())
        ends = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset:][: len(lengths) + 1]
        part = (ends[1:] - ends[0]) // size
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def stage_chunks(docs: DataFrame, label: str) -> DataFrame:
    """Write the documents (columns of ``internal``) as chunks to the shared folder."""

    def pack(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for piece in slices(batches):
            sink = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
            with pa.ipc.new_stream(sink, piece.schema, options=options) as out:
                out.write_batch(piece)
            data = sink.getvalue().to_pybytes()
            size = int(pa.compute.sum(pa.compute.binary_length(piece.column("text"))).as_py() or 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | seq]), pa.array([size]), pa.array([data], pa.binary())],
                ["chunk", "n_bytes", "payload"])
            seq += 1

    return materialize(docs.mapInArrow(pack, CHUNK_SCHEMA), label)


def buckets_for(chunks: DataFrame, bucket_bytes: int) -> int:
    """Buckets such that each gets the matches of so many bytes of text."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(16, -(-total // bucket_bytes))


class Chunk:
    """A chunk's documents as one array of bytes with the documents' boundaries."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        text = table.column("text")
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        self.table, (self.data, self.starts) = table, text_bytes(text)
        ids = table.column("id").to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0)
        if ids.dtype != np.int64:
            mask = table.column("id").is_null().to_numpy(zero_copy_only=False)
            filled = table.column("id").fill_null(NO_ID)
            ids = np.where(mask, NO_ID, filled.to_numpy(zero_copy_only=False).astype(np.int64))
        self.ids = ids.astype(np.int64)

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        bounds = self.starts.tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


def read_chunk(payload: bytes) -> Chunk:
    return Chunk(pa.ipc.open_stream(payload).read_all())


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes (null: empty) and each text's start, with the end."""
    raw = text.fill_null("").cast(pa.large_binary())
    if not len(raw):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:][: len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    return data, ends - ends[0]


# --- hashing -------------------------------------------------------------------------

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well mixed 64-bit value of each 64-bit value (the splitmix64 finaliser)."""
    x = np.asarray(x, np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _series(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or have.size < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * CHUNK_BYTES:  # a very long document's powers are not kept
            _powers[name] = have
    return have[:n]


class Spans:
    """Hashes of any spans of an array of bytes, from one running sum."""

    def __init__(self, data: np.ndarray, family: int = 0):
        """Hashes of different families (0, 1) are independent."""
        base = _BASE[family]
        self.total = np.zeros(data.size + 1, np.uint64)
        np.cumsum(_BYTE[family][data] * _series(f"up{family}", base, data.size), out=self.total[1:])
        self.down = _series(f"down{family}", pow(base, -1, 1 << 64), data.size + 1)

    @classmethod
    def over(cls, values: np.ndarray) -> Spans:
        """Hashes of spans of an array of 64-bit values."""
        made = cls.__new__(cls)
        made.total = np.zeros(values.size + 1, np.uint64)
        np.cumsum(values * _series("up0", _BASE[0], values.size), out=made.total[1:])
        made.down = _series("down0", pow(_BASE[0], -1, 1 << 64), values.size + 1)
        return made

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.total[ends] - self.total[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+``, and for each document
    boundary the number of words before it."""
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = starts[(starts > 0) & (starts < data.size)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, starts)


def owner(bounds: np.ndarray) -> np.ndarray:
    """For each item the document that it is in."""
    return np.repeat(np.arange(bounds.size - 1), np.diff(bounds))


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    step = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(step[:n]) > 0


def counts_in(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between each two bounds."""
    total = np.zeros(flags.size + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def runs(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of set flags; a run ends with its document."""
    padded = np.zeros(flags.size + 2, bool)
    padded[1:-1] = flags
    first, last = padded[1:-1] & ~padded[:-2], padded[1:-1] & ~padded[2:]
    inner = bounds[(bounds > 0) & (bounds < flags.size)]
    first[inner] = flags[inner]
    last[inner - 1] = flags[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket of a sorted array with its place."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts], [*cuts, bucket.size]):
        if b > a:
            yield int(bucket[a]), slice(int(a), int(b))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of sorted 64-bit keys by their upper half: rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
