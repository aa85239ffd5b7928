"""Projections, filters, unions, counts and order on repeats and work rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import durable, number_rows


def work_rows(sequences: DataFrame) -> DataFrame:
    """Sequences in the shape of the tagged frame: count and start 0, last position."""
    return sequences.select(
        "seq_id", "seq_name", F.col("seq").alias("text"), F.lit(0).cast("long").alias("cnt"),
        F.lit(0).cast("long").alias("start_pos"), (F.length("seq") - 1).cast("long").alias("end_pos"),
    )


def tagged(segments: DataFrame, repeats: DataFrame) -> DataFrame:
    """Segments (count 0) and repeats in one frame."""
    zero = F.lit(0).cast("long")
    return segments.select(
        "seq_id", "seq_name", F.col("chunk").alias("text"), zero.alias("cnt"),
        F.col("chunk_start").alias("start_pos"), zero.alias("end_pos"),
    ).unionByName(
        repeats.select("seq_id", "seq_name", F.col("motif").alias("text"), "cnt", "start_pos", "end_pos")
    )


def repeats_of(rows: DataFrame) -> DataFrame:
    return rows.where("cnt <> 0")


def segments_of(rows: DataFrame) -> DataFrame:
    return rows.where("cnt = 0")


def filter_by_seq_k(repeats: DataFrame, seq_id: int | None = None, k: int | None = None) -> DataFrame:
    if seq_id is not None:
        repeats = repeats.where(F.col("seq_id") == seq_id)
    return repeats if k is None else repeats.where(F.col("k") == k)


def min_repeat_filter(repeats: DataFrame, min_repeat: int) -> DataFrame:
    return repeats.where(F.col("cnt") >= min_repeat)


def short_form(repeats: DataFrame) -> DataFrame:
    """The four-column form: name, motif, count, start."""
    return repeats.select("seq_name", "motif", "cnt", "start_pos")


def union_repeats(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, duplicates kept."""
    return reduce(DataFrame.unionByName, frames)


def count_repeats(repeats: DataFrame) -> DataFrame:
    return repeats.agg(F.count("*").alias("n"))


def count_per_seq(repeats: DataFrame) -> DataFrame:
    return repeats.groupBy("seq_id").agg(F.count("*").alias("n"))


def sorted_repeats(repeats: DataFrame, rank: str = "rank") -> DataFrame:
    """Total order of repeats with its rank from 1.

    Sequence and start up, end and motif length down, motif for ties. A range
    sort, not a window over everything.
    """
    # a range sort looks at its input twice; repeats are few and costly to find
    keyed = durable(repeats).withColumn("_end_down", -F.col("end_pos")).withColumn("_k_down", -F.col("k"))
    order = ["seq_id", "start_pos", "_end_down", "_k_down", "motif"]
    numbered = number_rows(keyed, [], order, "_n")
    return numbered.withColumn(rank, F.col("_n") + 1).drop("_n", "_end_down", "_k_down")
