"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after every run of white space (``[\\x20\\x09-\\x0D]``)
is one space. Each level reads more of fewer rows:

1. Rows are counted by the length of their normalised text and a hash of its first
   ``PREFIX`` characters, in one scan with partial counts, so the largest group costs a row
   per task. A length that one row has is settled at once, and so is a prefix hash that one
   row of its length has.
2. What is left of that is a set of (length, prefix hash). The scan that comes next has to
   know whether a row belongs to it without sending any text, so the set goes to all tasks
   as a bitmap of ``BITS`` bits, whatever its size: a row whose bit is not set is unique. Two
   pairs on one bit only mean that a row is read in full that need not be.
3. Rows whose bit is set get the full hash (SHA-256), and groups are equal in length,
   prefix hash and full hash.

Groups with more than a ``1 / HEAVY`` part of the rows are fewer than ``HEAVY``, so they are
broadcast; members of all others meet their group in a shuffle.

Only DataFrame functions are used. Defined results: a null text is an empty one; of equal
texts the smallest id stays, null ids come last, and of rows that repeat the id too exactly
one stays; an empty table gives no rows. Nothing depends on how long a text is beyond what
one row of Spark can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.shared import internal, materialize

#: Characters of the first hash.
PREFIX = 64
#: Bits of the set of lengths and prefix hashes: 4 MB, broadcast.
BITS = 1 << 25
#: A group with more than one in so many rows is broadcast; there are fewer than that.
HEAVY = 1000

#: All white space that is not a single space already.
_TO_CHANGE = "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]"
#: Bits in one piece of a bitmap, as Spark's bitmap functions cut it.
_PIECE = 1 << 15


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _TO_CHANGE, " ")


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``internal`` columns with the normalised text, its length and its prefix hash."""
    rows = internal(docs, id_col, text_col).withColumn("plain", normalised(F.col("text")))
    return rows.withColumns({"length": F.octet_length("plain"),
                             "prefix": F.xxhash64(F.substring("plain", 1, PREFIX))})


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("length", "prefix"), F.lit(bits))


def _shared_prefixes(rows: DataFrame, bits: int) -> DataFrame:
    """Levels one and two: a bitmap of the (length, prefix hash) that several rows have,
    in at most ``bits / _PIECE`` rows of 4 KB."""
    counted = rows.groupBy("length", "prefix").count().where("count > 1").withColumn("place", _place(bits))
    pieces = counted.groupBy(F.bitmap_bucket_number("place").alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    return materialize(pieces, "shared-prefixes")


def _marked(rows: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``alive``: whether another row may have their length and prefix hash."""
    pieces = _shared_prefixes(rows, bits)
    placed = rows.withColumn("place", _place(bits)).withColumn("piece", F.bitmap_bucket_number("place"))
    # At most bits / _PIECE rows of 4 KB each, whatever the corpus.
    met = placed.join(F.broadcast(pieces), "piece", "left")
    bit = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substring("bitmap", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("getbit", byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    return met.withColumn("alive", F.coalesce(is_set, F.lit(False))).drop("place", "piece", "bitmap")


def _full_hash() -> Column:
    return F.unhex(F.sha2(F.col("plain").cast("binary"), 256))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                     digest: bool = False, bits: int = BITS) -> DataFrame:
    """Per document id, keep_id, group_size and kept. With ``digest`` also ``digest``, the
    SHA-256 of the normalised text of every row: those that level two settles are then
    hashed as well, for that column only."""
    marked = _marked(_measured(docs, id_col, text_col).select("id", "plain", "length", "prefix"), bits)
    wanted = F.lit(True) if digest else F.col("alive")
    # Written once: a row's number has to stay the same for all that follows.
    hashed = materialize(marked.select(
        F.monotonically_increasing_id().alias("row"), "id", "alive", "length", "prefix",
        F.when(wanted, _full_hash()).alias("full")), "full-hashes")
    same = ["length", "prefix", "full"]
    groups = hashed.where("alive").groupBy(*same).agg(
        F.count("*").alias("group_size"),
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first"))
    groups = materialize(groups.where("group_size > 1").select(
        *same, "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")), "groups")
    heavy = groups.where(F.col("group_size") * HEAVY > hashed.count())
    light = groups.join(F.broadcast(heavy), same, "left_anti")
    of_heavy = hashed.join(F.broadcast(heavy), same)  # fewer than HEAVY groups
    others = hashed.join(F.broadcast(heavy), same, "left_anti")
    of_light = others.where("alive").join(light, same, "left")
    columns = [*hashed.columns, "group_size", "keep_id", "keep_row"]
    alone = others.where("NOT alive").withColumns({
        "group_size": F.lit(None).cast("long"), "keep_id": F.lit(None).cast("long"),
        "keep_row": F.lit(None).cast("long")})
    every = of_heavy.select(*columns).unionByName(of_light.select(*columns)).unionByName(alone.select(*columns))
    several = F.col("group_size").isNotNull()
    return every.select(
        "id", F.when(several, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (~several | (F.col("keep_row") == F.col("row"))).alias("kept"),
        *([F.col("full").alias("digest")] if digest else []))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
             bits: int = BITS) -> DataFrame:
    """One row of each group of equal texts, with all its columns unchanged.

    Rows that level two settles stay where they are; of the others each task forwards one
    row per group (a group limit before the shuffle)."""
    marked = _marked(_measured(docs, id_col, text_col), bits)
    rest = ["rest"] if "rest" in marked.columns else []
    columns = ["id", "text", *rest]
    order = Window.partitionBy("length", "prefix", "full").orderBy(
        F.col("id").asc_nulls_last(), F.xxhash64("text"))
    first = marked.where("alive").withColumn("full", _full_hash()).select(
        *columns, "length", "prefix", "full").withColumn("place", F.row_number().over(order)).where("place = 1")
    left = marked.where("NOT alive").select(*columns).unionByName(first.select(*columns))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    place = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)} | {
        id_col: F.col("id").cast(docs.schema[id_col].dataType), text_col: F.col("text")}
    return left.select(*[place[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS plain FROM documents),
placed AS (
  SELECT doc_id, plain, count(*) OVER (PARTITION BY plain) AS group_size,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM normal WINDOW w AS (PARTITION BY plain ORDER BY doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(plain) AS text_sha256 FROM placed"""
