"""Scan of segments on their own, with border repeats masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import Rule
from ..sources.chunks import chunk_sequences
from .blocks import durable, join_few
from .exact import REPEAT_COLUMNS, REPEAT_SCHEMA
from .intervals import overlap_join, partial_units
from .resolve import ranked_reader
from .tolerant import cut_spanning_runs, ordered_reader


def segments(df: DataFrame, size: int) -> DataFrame:
    """Half-open segments of ``size`` characters with their first and last position."""
    chunks = chunk_sequences(df, size)
    return chunks.withColumn("seg_start", F.col("chunk_start")).withColumn(
        "seg_end", F.col("chunk_start") + F.length("chunk") - 1
    )


def border_repeats(df: DataFrame, size: int, rule: Rule, **options) -> DataFrame:
    """Repeats that cover the first position of a segment other than the first one.

    A repeat found at several borders is listed once.
    """
    cuts = chunk_sequences(df, size).where("chunk_id > 0").select("seq_id", F.col("chunk_start").alias("cut"))
    return cut_spanning_runs(df, cuts, rule, **options).drop("cut").distinct()


def segment_overlap_join(segs: DataFrame, repeats: DataFrame, size: int, how: str = "left") -> DataFrame:
    """:func:`overlap_join` of segments of ``size`` characters."""
    return overlap_join(segs, repeats, size, how, aligned=True)


def masked_segment_scan(
    df: DataFrame, size: int, rule: Rule, mask: DataFrame | None = None, extend: bool = True
) -> DataFrame:
    """Repeats found inside each segment that are not wholly inside the mask.

    ``mask`` are repeats ``(seq_id, motif, start_pos, end_pos)``, by default the
    border repeats. With ``extend`` they also cover the partial units next to them.
    """
    if mask is None:
        mask = border_repeats(df, size, rule)
    segs = segments(df, size)
    narrow = segs.select("seq_id", "chunk_id", "seg_start", "seg_end")
    pairs = segment_overlap_join(narrow, mask.select("seq_id", "motif", "start_pos", "end_pos"), size, "inner")
    # distinct repeats over one segment: bounded by the segment
    masks = pairs.groupBy("seq_id", "chunk_id").agg(
        F.collect_set(F.struct("motif", "start_pos", "end_pos")).alias("_over")
    )
    first, last = F.col("seg_start"), F.col("seg_end")

    def cell(over: Column) -> Column:
        begin, stop = over["start_pos"], over["end_pos"]
        if extend:
            before, after = partial_units(F.col("chunk"), first, last, over["motif"], begin, stop)
            begin, stop = begin - before, stop + after
        return F.struct(
            (F.greatest(begin, first) - first).alias("s"), (F.least(stop, last) - first).alias("e")
        )

    settled = rule.exact and rule.policy == "ranked" and not rule.every_start
    reader = ranked_reader(rule) if settled else ordered_reader(rule)
    joined = join_few(segs, masks, ["seq_id", "chunk_id"], "left").withColumn("mask", F.transform("_over", cell))
    return joined.select("seq_id", "seq_name", "chunk_start", "chunk", "mask").mapInArrow(reader, REPEAT_SCHEMA)


def split_repeats(df: DataFrame, size: int, rule: Rule, extend: bool = True) -> DataFrame:
    """The split job: repeats over segment borders, and those inside segments that they do not cover."""
    border = durable(border_repeats(df, size, rule).select(*REPEAT_COLUMNS))
    return border.unionByName(masked_segment_scan(df, size, rule, border, extend))
