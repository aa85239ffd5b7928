"""Coverage as bitmaps: a bit a position, a row for each block of 32,768 positions with a covered one.

Bit ``p % 8`` of byte ``p // 8`` of a block is its position p, as in Spark's bitmap
functions. Positions are rows only until the partial aggregate before the
shuffle; what is shuffled are bitmaps of 4 KB.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import cut_at_blocks, merge_intervals

CELLS = 1 << 15  # positions of a bitmap; fixed by Spark
_DIGITS = "0123456789ABCDEF"


def coverage_bitmaps(
    df: DataFrame, keys: list[str] = ("seq_id",), start: str = "start_pos", end: str = "end_pos"
) -> DataFrame:
    """``keys, block, bitmap`` of the positions that the intervals of ``df`` cover.

    Intervals are merged first, so a position is set once however often it is
    covered. Blocks without a covered position have no row.
    """
    keys = list(keys)
    pieces = cut_at_blocks(merge_intervals(df, keys, start=start, end=end), CELLS, start, end)
    cells = pieces.select(*keys, F.col("_block").alias("block"), F.explode(F.sequence("_s", "_e")).alias("_cell"))
    bit = F.bitmap_bit_position(F.col("_cell") + 1)  # Spark's bitmaps begin with position 1
    return cells.groupBy(*keys, "block").agg(F.bitmap_construct_agg(bit).alias("bitmap"))


def union(*masks: DataFrame) -> DataFrame:
    """Positions covered in any of several masks."""
    rows = reduce(DataFrame.unionByName, masks)
    return rows.groupBy(*[c for c in rows.columns if c != "bitmap"]).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def without(mask: DataFrame, other: DataFrame) -> DataFrame:
    """Positions covered in ``mask`` and not in ``other``; blocks with none of them have no row."""
    keys = [c for c in mask.columns if c != "bitmap"]
    # a and not b = not (not a or b), so that both sides are one aggregate
    sides = mask.select(*keys, inverse(F.col("bitmap")).alias("bitmap"), F.lit(True).alias("_mine")).unionByName(
        other.select(*keys, "bitmap", F.lit(False).alias("_mine"))
    )
    both = sides.groupBy(*keys).agg(F.bitmap_or_agg("bitmap").alias("bitmap"), F.max("_mine").alias("_mine"))
    left = both.where("_mine").select(*keys, inverse(F.col("bitmap")).alias("bitmap"))
    return left.where(F.bitmap_count("bitmap") > 0)


def inverse(bitmap: Column) -> Column:
    return F.unhex(F.translate(F.hex(bitmap), _DIGITS, _DIGITS[::-1]))


def described(mask: DataFrame) -> DataFrame:
    """``covered`` positions, their share ``density`` of a block, and ``bits`` in hex up to the last byte with a bit."""
    digits = F.rtrim(F.hex("bitmap"), F.lit("0"))
    bits = F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)
    covered = F.bitmap_count("bitmap")
    return mask.select(
        *[c for c in mask.columns if c != "bitmap"], covered.alias("covered"), (covered / F.lit(float(CELLS))).alias("density"),
        bits.alias("bits"),
    )
