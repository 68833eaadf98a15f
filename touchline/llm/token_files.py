"""Token ids in files of directly addressable codes.

An id is cut into chunks of bits, low ones first. Level k holds the k-th chunk of those
ids that have one, a continuation bitmap tells which ids go on to the next level, and a
rank directory (ones before every 512th bit) gives an id's place there. So any token is
read by one look per level, without decoding what lies before it. Widths are chosen per
segment, by the size they give.

A file is a Parquet table of segments in ascending doc_id order; a segment is one
self-contained binary value with its documents' ids and bounds. Spark's writer commits
segments, so a lost executor leaves no half-written file, and any file system will do.

Defined results: a null or empty text is the end id alone; documents with a null id come
last; rows with one id are in the order of a hash of their text, and equal rows are kept;
an empty table gives a file without segments.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.shared import internal, scratch_path, slices
from touchline.llm.tokens import encode_texts

MAGIC = b"DAC1"
#: Tokens after which a segment ends; a longer document is a segment of its own.
SEGMENT = 1 << 20
RANK_STEP = 512
MAX_WIDTH = 16
SEGMENT_SCHEMA = "shard int, seq int, n_docs long, n_tokens long, data binary"


# --- the format -------------------------------------------------------------------------

def pack_bits(values: np.ndarray, width: int) -> bytes:
    bits = np.empty((values.size, width), np.uint8)
    for k in range(width):
        bits[:, k] = (values >> np.uint32(k)) & np.uint32(1)
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def widths_for(ids: np.ndarray) -> list[int]:
    """Chunk widths with the smallest size: chunks, bitmaps and directories."""
    top = max(1, int(ids.max(initial=0)).bit_length())
    more = [int(np.count_nonzero(ids >> np.uint32(t))) if t else ids.size for t in range(top)]
    best: dict[int, tuple[float, list[int]]] = {top: (0.0, [])}
    flag = 1 + 32 / RANK_STEP
    for t in range(top - 1, -1, -1):
        best[t] = min(
            (more[t] * (w + (flag if t + w < top else 0)) + best[t + w][0], [w, *best[t + w][1]])
            for w in range(1, min(MAX_WIDTH, top - t) + 1))
    return best[0][1]


def write_segment(ids: np.ndarray, bounds: np.ndarray, doc_ids: np.ndarray, null_ids: np.ndarray) -> bytes:
    """Header, documents, then for each level its width, count, chunks, bitmap, directory."""
    ids = ids.astype(np.uint32)
    widths = widths_for(ids)
    out = [MAGIC, struct.pack("<QQB", doc_ids.size, ids.size, len(widths)),
           doc_ids.astype("<i8").tobytes(), np.packbits(null_ids).tobytes(), bounds.astype("<u8").tobytes()]
    left = ids
    for k, width in enumerate(widths):
        out += [struct.pack("<BQ", width, left.size), pack_bits(left, width)]
        if k + 1 < len(widths):
            high = left >> np.uint32(width)
            goes_on = high > 0
            ones = np.zeros(-(-left.size // RANK_STEP) + 1, np.uint32)
            counts = np.add.reduceat(goes_on, np.arange(0, max(1, left.size), RANK_STEP), dtype=np.uint32) \
                if left.size else np.zeros(0, np.uint32)
            np.cumsum(counts, out=ones[1:1 + counts.size])
            out += [np.packbits(goes_on, bitorder="little").tobytes(), ones.astype("<u4").tobytes()]
            left = high[goes_on]
    return b"".join(out)


class Segment:
    """Reads a segment; ``ids_at`` gives the tokens at any places."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.n_docs, self.n_tokens, levels = struct.unpack_from("<QQB", data, 4)
        at = 4 + struct.calcsize("<QQB")

        def take(dtype, count):
            nonlocal at
            got = np.frombuffer(data, dtype, count, at)
            at += got.nbytes
            return got

        self.doc_ids = take("<i8", self.n_docs)
        self.null_ids = np.unpackbits(take(np.uint8, -(-self.n_docs // 8)), count=self.n_docs).astype(bool)
        self.bounds = take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for k in range(levels):
            width, count = struct.unpack_from("<BQ", data, at)
            at += struct.calcsize("<BQ")
            chunks = np.concatenate([take(np.uint8, -(-count * width // 8)), np.zeros(4, np.uint8)])
            bitmap = directory = None
            if k + 1 < levels:
                bitmap = np.concatenate([take(np.uint8, -(-count // 8)), np.zeros(RANK_STEP // 8, np.uint8)])
                directory = take("<u4", -(-count // RANK_STEP) + 1)
            self.levels.append((width, chunks, bitmap, directory))

    def ids_at(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(places.size, np.uint32)
        at, who, shift = places.astype(np.int64), np.arange(places.size), 0
        for width, chunks, bitmap, directory in self.levels:
            bit = at * width
            byte = bit >> 3
            word = (chunks[byte].astype(np.uint32) | chunks[byte + 1].astype(np.uint32) << np.uint32(8)
                    | chunks[byte + 2].astype(np.uint32) << np.uint32(16))
            value = (word >> (bit & 7).astype(np.uint32)) & np.uint32((1 << width) - 1)
            out[who] |= value << np.uint32(shift)
            if bitmap is None:
                break
            on = ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            who, at = who[on], _rank(bitmap, directory, at[on])
            shift += width
            if not who.size:
                break
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids_at(np.arange(self.bounds[k], self.bounds[k + 1]))


def _rank(bitmap: np.ndarray, directory: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ones before each place: the directory's count and those since its last entry."""
    if not at.size:
        return at
    step, words = at // RANK_STEP, bitmap[: bitmap.size // 8 * 8].view("<u8")
    out = directory[step].astype(np.int64)
    word, first = at >> 6, step * (RANK_STEP // 64)
    low, high = int(first.min()), min(int(word.max()) + 1, words.size)
    ones = np.zeros(high - low + 1, np.int64)
    np.cumsum(np.bitwise_count(words[low:high]), out=ones[1:])
    out += ones[word - low] - ones[first - low]
    below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return out + np.bitwise_count(words[word] & below)


# --- Spark ------------------------------------------------------------------------------

def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = 1) -> None:
    """Encode all texts and write the file to ``path``, in ascending order of ids."""
    rows = internal(docs, id_col, text_col).select("id", "text")
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text").asc()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def encode(batches):
        shard, seq, held, tokens = TaskContext.get().partitionId(), 0, [], 0

        def segment():
            sizes = np.concatenate([s for s, _, _, _ in held])
            bounds = np.zeros(sizes.size + 1, np.int64)
            np.cumsum(sizes, out=bounds[1:])
            data = write_segment(np.concatenate([x for _, x, _, _ in held]), bounds,
                                 np.concatenate([d for _, _, d, _ in held]),
                                 np.concatenate([n for _, _, _, n in held]))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([sizes.size]),
                 pa.array([int(bounds[-1])]), pa.array([data], pa.binary())],
                ["shard", "seq", "n_docs", "n_tokens", "data"])

        for block in slices(batches, 1 << 20):
            texts = [t or "" for t in block.column("text").to_pylist()]
            ids, bounds = encode_texts(texts, tokenizer_path, False)
            ids = np.insert(ids, bounds[1:], np.uint32(end_id))
            null = block.column("id").is_null().to_numpy(zero_copy_only=False)
            doc_ids = block.column("id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((np.diff(bounds) + 1, ids, doc_ids, null))
            tokens += ids.size
            if tokens >= SEGMENT:
                yield segment()
                seq, held, tokens = seq + 1, [], 0
        if held:
            yield segment()

    segments = sorted_.mapInArrow(encode, SEGMENT_SCHEMA)
    segments.write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The file's documents: id, start, n_tokens, ids (little-endian 32-bit), ids_crc32."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)

    def decode(batches):
        for batch in batches:
            for shard, seq, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "seq", "data"))):
                own = Segment(data)
                for first in range(0, own.n_docs, 2_000):
                    bounds = own.bounds[first:first + 2_001]
                    n = bounds.size - 1
                    raw = own.ids_at(np.arange(bounds[0], bounds[-1])).astype("<u4").tobytes()
                    at = ((bounds - bounds[0]) * 4).tolist()
                    each = [raw[a:b] for a, b in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * n, pa.int32()), pa.array([seq] * n, pa.int32()),
                         pa.array(own.doc_ids[first:first + n], mask=own.null_ids[first:first + n]),
                         pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(each, pa.binary()),
                         pa.array([zlib.crc32(x) for x in each], pa.int64())],
                        ["shard", "seq", "id", "local", "n_tokens", "ids", "ids_crc32"])

    found = segments.select("shard", "seq", "data").mapInArrow(
        decode, "shard int, seq int, id long, local long, n_tokens long, ids binary, ids_crc32 long")
    # Tokens before a segment: before its shard (one row per shard), and in the shard.
    totals = segments.select("shard", "seq", "n_tokens")
    in_shard = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.groupBy("shard").agg(F.sum("n_tokens").alias("all"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    starts = totals.withColumn("inner", F.coalesce(F.sum("n_tokens").over(in_shard), F.lit(0))).join(
        shards, "shard").select("shard", "seq", (F.col("base") + F.col("inner")).alias("base"))
    return found.join(starts, ["shard", "seq"]).select(
        "id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids", "ids_crc32")


def token_file(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write a file in the shared folder and read it back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, **options)
    return read_tokens(docs.sparkSession, path)
