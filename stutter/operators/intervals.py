"""Interval operators. Positions are 0-based, both ends inclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import BLOCK, div, join_few, number_rows, previous, weighed

_BORDER = -1


def cut_at_blocks(df: DataFrame, block: int, start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """One row per (interval, block of positions); ``_block``, ``_s`` and ``_e`` are added."""
    blocks = F.explode(F.sequence(div(start, block), div(end, block)))
    return (
        df.withColumn("_block", blocks)
        .withColumn("_s", F.greatest(F.col(start), F.col("_block") * block))
        .withColumn("_e", F.least(F.col(end), (F.col("_block") + 1) * block - 1))
    )


def _islands(df: DataFrame, keys: list[str], firsts: list[str]) -> DataFrame:
    """Merge overlapping or touching ``[_s, _e]`` within ``keys``."""
    by_start = W.partitionBy(*keys).orderBy("_s", "_e")
    reach = F.max("_e").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.col("_s") <= F.col("_reach") + 1, F.lit(0)).otherwise(F.lit(1))
    grouped = (
        df.withColumn("_reach", reach)
        .withColumn("_opens", opens)
        .withColumn("_island", F.sum("_opens").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    )
    return grouped.groupBy(*keys, "_island").agg(
        F.min("_s").alias("_s"), F.max("_e").alias("_e"), *[F.min_by(c, "_s").alias(c) for c in firsts]
    )


def merge_intervals(
    df: DataFrame,
    keys: list[str] = ("seq_id",),
    firsts: list[str] = (),
    block: int = BLOCK,
    start: str = "start_pos",
    end: str = "end_pos",
    distinct_starts: bool = True,
) -> DataFrame:
    """Union of intervals as disjoint, non-adjacent intervals per ``keys``.

    Intervals are cut at block borders, merged per (keys, block), and only the
    pieces that touch a border are merged again per keys. ``firsts`` are columns
    taken from the leftmost interval of each union. ``distinct_starts`` folds
    intervals with one start before the shuffle, so that a block never holds more
    rows than positions; leave it out for intervals that cannot repeat.
    """
    keys, firsts = list(keys), list(firsts)
    cut = cut_at_blocks(df, block, start, end)
    if distinct_starts:
        cut = cut.groupBy(*keys, "_block", "_s").agg(
            F.max("_e").alias("_e"), *[F.min(c).alias(c) for c in firsts]
        )
    else:
        cut = cut.select(*keys, "_block", "_s", "_e", *firsts)
    inside = _islands(cut, [*keys, "_block"], firsts)
    touches = (F.col("_s") % block == 0) | ((F.col("_e") + 1) % block == 0)
    linked = inside.withColumn("_block", F.when(touches, F.lit(_BORDER)).otherwise(F.col("_block")))
    merged = _islands(linked.drop("_island"), [*keys, "_block"], firsts)
    return merged.select(*keys, F.col("_s").alias(start), F.col("_e").alias(end), *firsts)


def covering(
    points: DataFrame, merged: DataFrame, at: str, keys: list[str] = ("seq_id",), block: int = BLOCK
) -> DataFrame:
    """For each point, the interval of a merged set that holds it, or null.

    Adds ``cover_start`` and ``cover_end``. Points and intervals meet per
    (keys, block) and are read once in order; no pairs are formed.
    """
    keys = list(keys)
    cols = points.columns
    span = F.struct(F.col("start_pos").alias("s"), F.col("end_pos").alias("e"))
    pieces = cut_at_blocks(merged, block).select(
        *keys, "_block", F.col("_s").alias("_at"), F.lit(0).alias("_side"), span.alias("_span"),
        F.lit(None).cast(points.select(F.struct(*cols)).schema[0].dataType).alias("_point"),
    )
    asked = points.select(
        *keys, div(at, block).alias("_block"), F.col(at).alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast("struct<s:bigint,e:bigint>").alias("_span"), F.struct(*cols).alias("_point"),
    )
    upto = W.partitionBy(*keys, "_block").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    last = F.last("_span", ignorenulls=True).over(upto)
    seen = pieces.unionByName(asked).withColumn("_last", last).where("_side = 1")
    holds = F.col("_last.e") >= F.col("_at")
    return seen.select(
        *[F.col(f"_point.{c}").alias(c) for c in cols],
        F.when(holds, F.col("_last.s")).alias("cover_start"),
        F.when(holds, F.col("_last.e")).alias("cover_end"),
    )


_NEAR = 1 << 10  # positions whose covered spans are looked at together


def uncovered_intervals(df: DataFrame, mask: DataFrame, keys: list[str] = ("seq_id",)) -> DataFrame:
    """Intervals with at least one position outside the union of ``mask``.

    A mask of few bytes is sent to the intervals; a larger one meets them in order.
    """
    keys = list(keys)
    merged, small = weighed(merge_intervals(mask, keys))
    if not small:
        found = covering(df, merged, "start_pos", keys)
        inside = F.coalesce(F.col("cover_end") >= F.col("end_pos"), F.lit(False))
        return found.where(~inside).select(*df.columns)
    span = F.struct(F.col("start_pos").alias("s"), F.col("end_pos").alias("e"))
    spans = cut_at_blocks(merged, _NEAR).groupBy(*keys, "_block").agg(F.collect_list(span).alias("_spans"))
    holds = F.exists("_spans", lambda x: (x["s"] <= F.col("start_pos")) & (x["e"] >= F.col("end_pos")))
    near = df.withColumn("_block", div("start_pos", _NEAR)).join(F.broadcast(spans), [*keys, "_block"], "left")
    return near.where(~F.coalesce(holds, F.lit(False))).select(*df.columns)


def overlap_join(segments: DataFrame, repeats: DataFrame, block: int, how: str = "left", aligned: bool = False) -> DataFrame:
    """Segments with every repeat of the same sequence that overlaps them.

    Both sides are cut into position blocks and joined on (seq_id, block); a pair
    is kept in the first block both share. ``segments`` carry ``seg_start`` and
    ``seg_end``, ``repeats`` carry ``start_pos`` and ``end_pos``. ``aligned``
    segments never cross a block border, so each meets a repeat once.
    """
    right = repeats.withColumn(
        "_block", F.explode(F.sequence(div("start_pos", block), div("end_pos", block)))
    )
    if aligned:
        right = right.withColumnRenamed("seq_id", "_seq_id").withColumnRenamed("_block", "_near")
        meets = (
            (F.col("seq_id") == F.col("_seq_id")) & (F.col("_block") == F.col("_near"))
            & (F.col("start_pos") <= F.col("seg_end")) & (F.col("end_pos") >= F.col("seg_start"))
        )
        pairs = join_few(segments.withColumn("_block", div("seg_start", block)), right, meets, how)
        return pairs.drop("_block", "_near", "_seq_id")
    left = segments.withColumn(
        "_block", F.explode(F.sequence(div("seg_start", block), div("seg_end", block)))
    )
    pairs = join_few(left, right, ["seq_id", "_block"]).where(
        (F.col("start_pos") <= F.col("seg_end"))
        & (F.col("end_pos") >= F.col("seg_start"))
        & (F.col("_block") == div(F.greatest("seg_start", "start_pos"), block))
    ).drop("_block")
    if how == "inner":
        return pairs
    own = ["seq_id", "seg_start", "seg_end"]  # names a segment
    rest = [c for c in repeats.columns if c not in segments.columns]
    return segments.join(pairs.select(*own, *rest), own, "left")


def clip_intervals(pairs: DataFrame) -> DataFrame:
    """Cut overlapping intervals to their segment; adds ``clip_start``, ``clip_end``."""
    return pairs.withColumn("clip_start", F.greatest("start_pos", "seg_start")).withColumn(
        "clip_end", F.least("end_pos", "seg_end")
    )


def report_order() -> list[Column]:
    """Within one sequence: start up, end down, motif length down, motif for ties."""
    return [
        F.col("start_pos").asc(), F.col("end_pos").desc(), F.col("k").desc(), F.col("motif").asc(),
    ]


def drop_contained(df: DataFrame, running: bool = False) -> DataFrame:
    """Keep repeats that reach past the previous repeat of the same sequence.

    The first repeat of a sequence is kept. ``running=True`` compares with the
    farthest end so far instead of the previous row.
    """
    if running:
        return _drop_contained_running(df)
    with_prev = previous(df, ["seq_id"], "start_pos", report_order(), {"_prev": F.col("end_pos")})
    floor = F.when(F.col("seq_id") == 0, F.lit(0))  # reading begins in sequence 0, with end 0
    prev = F.coalesce(F.col("_prev"), floor)
    return with_prev.where(prev.isNull() | (F.col("end_pos") > prev)).drop("_prev")


def _drop_contained_running(df: DataFrame) -> DataFrame:
    # A repeat is passed over if an earlier one reaches at least as far. All earlier
    # starts of the same block are compared in order, all earlier blocks by their maximum.
    here = W.partitionBy("seq_id", "_block").orderBy(*report_order())
    blocked = df.withColumn("_block", div("start_pos", BLOCK)).withColumn(
        "_inner", F.max("end_pos").over(here.rowsBetween(W.unboundedPreceding, -1))
    )
    tops = df.groupBy("seq_id", div("start_pos", BLOCK).alias("_block")).agg(F.max("end_pos").alias("_top"))
    earlier = W.partitionBy("seq_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.withColumn("_outer", F.max("_top").over(earlier)).drop("_top")
    far = F.greatest("_inner", "_outer")
    kept = blocked.join(tops, ["seq_id", "_block"]).where(far.isNull() | (F.col("end_pos") > far))
    return kept.select(*df.columns)


def drop_contained_global(df: DataFrame, block: int = 1 << 16) -> DataFrame:
    """As :func:`drop_contained`, but the previous row may belong to another sequence."""
    with_prev = previous(df, ["seq_id"], "start_pos", report_order(), {"_prev": F.col("end_pos")})
    # the last row of each sequence, handed to the next sequence that has rows
    rank = F.struct("start_pos", -F.col("end_pos"), -F.col("k"), "motif")
    lasts = df.groupBy("seq_id").agg(F.max_by("end_pos", rank).alias("_last"))
    # no key here: the ranks of sequences are the positions, so that blocks are full whatever the ids are
    ranked = number_rows(lasts, [], ["seq_id"], "_rank")
    linked = previous(ranked, [], "_rank", [F.col("_rank").asc()], {"_before": F.col("_last")}, block)
    joined = with_prev.join(linked.select("seq_id", "_before"), "seq_id")
    prev = F.coalesce("_prev", "_before", F.lit(0))
    return joined.where(F.col("end_pos") > prev).select(*df.columns)


def partial_units(
    text: Column, seg_start: Column, seg_end: Column, motif: Column, start: Column, end: Column
) -> tuple[Column, Column]:
    """Characters (before, after) a border repeat that go on with part of its unit.

    Before a repeat that crosses the right border of its segment, after one that
    crosses the left border; less than a motif each, and inside the segment.
    """
    spare = F.length(motif) - 1
    after = F.substring(text, (end - seg_start + 2).cast("int"), spare)
    at = start - seg_start  # characters of the segment before the repeat
    low = F.greatest(at - spare, F.lit(0))
    before = F.substring(text, (low + 1).cast("int"), F.greatest(at - low, F.lit(0)).cast("int"))

    def agreeing(unit: Column, other: Column) -> Column:
        # both sides as arrays of characters, so that a long motif is walked once
        same = F.zip_with(
            F.split(F.substring(unit, F.lit(1), spare), ""), F.split(other, ""),
            lambda a, b: F.coalesce(a == b, F.lit(False)),
        )
        differs = F.array_position(same, False)
        return F.when(spare < 1, F.lit(0)).when(differs == 0, spare).otherwise(differs - 1)

    crosses_left = (start <= seg_start) & (end >= seg_start)
    crosses_right = (end >= seg_end) & (start <= seg_end)
    return (
        F.when(crosses_right, agreeing(F.reverse(motif), F.reverse(before))).otherwise(F.lit(0)).cast("long"),
        F.when(crosses_left, agreeing(motif, after)).otherwise(F.lit(0)).cast("long"),
    )


def partial_unit_extension(pairs: DataFrame) -> DataFrame:
    """Add ``ext_before`` and ``ext_after`` of :func:`partial_units`.

    ``pairs`` are segments (``chunk``, ``seg_start``, ``seg_end``) with repeats
    (``motif``, ``start_pos``, ``end_pos``) that overlap them.
    """
    before, after = partial_units(
        *[F.col(c) for c in ("chunk", "seg_start", "seg_end", "motif", "start_pos", "end_pos")]
    )
    return pairs.withColumn("ext_before", before).withColumn("ext_after", after)
