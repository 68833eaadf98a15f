"""Sets of numbers as bitmaps of 2**15 bits, as Spark's bitmap functions cut them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmaps(rows: DataFrame, number: str) -> DataFrame:
    """(block, bitmap): the distinct values of a column, one row for each block of them."""
    return rows.groupBy(F.bitmap_bucket_number(number).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap"))


def has_bit(bitmap: Column, number: Column) -> Column:
    """Whether a bitmap of the number's block holds the number."""
    place = F.bitmap_bit_position(number)
    byte = F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.call_function("getbit", value, F.pmod(place, F.lit(8)).cast("int")) == 1
