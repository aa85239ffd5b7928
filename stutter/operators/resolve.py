"""Motif lengths that compete for the same positions, exact mode.

Lengths are taken in list order. A region is reported if it still reaches a
position that no earlier report covers; if only its spare tail is free it is
reported in a later phase, otherwise it is dropped.

A sequence that fits in one chunk is settled where it is read, without a
shuffle. Longer ones are settled by set operations, one pass per motif length,
on groups bounded by position blocks: even a single sequence that holds a third
of all regions spreads over the cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.scan import Rule
from ..sources.chunks import CHUNK_SIZE, chunk_sequences, is_pieces
from .blocks import BLOCK, div, durable, durable_counted, previous
from .exact import (
    REPEAT_ARROW,
    REPEAT_SCHEMA,
    RowSpans,
    as_repeats,
    exact_regions,
    slices,
)
from .intervals import covering, merge_intervals


def repeats_batch(part: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
    """Arrow rows from (row, k, motif, cnt, start, end) in chunk coordinates."""
    cells = list(zip(*found)) if found else [()] * 6
    take = pa.array(cells[0], pa.int64())
    return pa.RecordBatch.from_arrays(
        [part.column("seq_id").take(take), part.column("seq_name").take(take),
         pa.array(cells[1], pa.int32()), pa.array(cells[2], pa.string()),
         pa.array(cells[3], pa.int64()), pa.array(cells[4], pa.int64()), pa.array(cells[5], pa.int64())],
        schema=REPEAT_ARROW,
    )


def _whole_regions(rows: RowSpans, k: int, rule: Rule):
    """(row, start in row, length) of the regions of one motif length."""
    first, length = scan.long_runs(rows.same(k), (rule.min_repeat - 1) * k)
    at = np.searchsorted(rows.stop, first, side="right")
    for a, m, r in zip(first.tolist(), length.tolist(), at.tolist()):
        if not rule.primitive_only or scan.is_primitive(rows.text[a : a + k]):
            yield r, a - int(rows.start[r]), m + k


def ranked_reader(rule: Rule):
    """Task function: ranked exact repeats of rows ``(seq_id, seq_name, chunk_start, chunk[, mask])``."""

    def read(batches):
        for batch in batches:
            for part, texts in slices(batch, "chunk"):
                rows = RowSpans(texts)
                per_row: dict[int, list] = {}
                for k in rule.k_list:
                    for r, a, length in _whole_regions(rows, k, rule):
                        per_row.setdefault(r, []).append((k, a, length))
                found = []
                for r, regions in per_row.items():
                    text, origin, taken = texts[r], part["chunk_start"][r].as_py(), cells_taken(part, r, texts)
                    for k, a, cnt in scan.exact_ranked(len(text), regions, taken):
                        at = a + origin
                        found.append((r, k, text[a : a + k], cnt, at, at + cnt * k - 1))
                if found:
                    yield repeats_batch(part, found)

    return read


def cells_taken(part: pa.RecordBatch, r: int, texts: list[str]) -> bytearray:
    """Cells of row ``r`` that its ``mask`` covers, if the rows have one."""
    taken = bytearray(len(texts[r]))
    cells = part["mask"][r].as_py() if "mask" in part.schema.names else None
    for cell in cells or ():
        taken[cell["s"] : cell["e"] + 1] = b"\x01" * (cell["e"] + 1 - cell["s"])
    return taken


def read_whole(df: DataFrame, size: int, reader) -> tuple[DataFrame, DataFrame | None]:
    """Read every sequence of at most ``size`` characters where it is.

    Returns (repeats, longer sequences or None). The input is read once; its long
    sequences leave a marker in place of their text, and only if there are any is
    the input looked at again, by the caller.
    """
    if is_pieces(df):
        rows = chunk_sequences(df, size, halo=1).where("chunk_id = 0")
        text = F.when(F.length("chunk") <= size, F.col("chunk"))
    else:
        rows = df.where(F.col("seq").isNotNull()).withColumn("chunk_start", F.lit(0).cast("long"))
        text = F.when(F.length("seq") <= size, F.col("seq"))
    rows = rows.select("seq_id", "seq_name", "chunk_start", text.alias("chunk"))

    def read(batches):
        for batch in batches:
            long = batch.filter(pc.is_null(batch.column("chunk")))
            if long.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [long["seq_id"], long["seq_name"]]
                    + [pa.nulls(long.num_rows, f.type) for f in list(REPEAT_ARROW)[2:]],
                    schema=REPEAT_ARROW,
                )
            yield from reader([batch.filter(pc.is_valid(batch.column("chunk")))])

    found, markers = durable_counted(rows.mapInArrow(read, REPEAT_SCHEMA), F.col("k").isNull())
    if not markers:
        return found, None
    if is_pieces(df):
        long = df.join(found.where("k is null").select("seq_id"), "seq_id", "left_semi")
    else:
        long = df.where(F.length("seq") > size)
    return found.where("k is not null"), long


def _settle_chain(df: DataFrame, block: int) -> DataFrame:
    """Decide ``_whole`` (reported in its first phase) for regions in order.

    Whether a region keeps its first phase can depend on whether the region just
    before it did: ``_if_whole`` and ``_if_not``. Such a step keeps, turns or
    fixes the answer, so the answer is the last fixed one, turned as often as
    turning steps follow. Counted per block; the answer at a block's end is then
    handed to the next block.
    """
    fixed = F.col("_if_whole") == F.col("_if_not")
    turn = F.when(~fixed & F.col("_if_not"), F.lit(1)).otherwise(F.lit(0))
    order = [F.col("start_pos").asc()]

    def answer(value, total):  # flip `value` if the number of turns is odd
        return F.when(total % 2 == 0, value).otherwise(~value)

    here = W.partitionBy("seq_id", "_block").orderBy(*order)
    upto = here.rowsBetween(W.unboundedPreceding, 0)
    inside = (
        df.withColumn("_block", div("start_pos", block))
        .withColumn("_turns", F.sum(turn).over(upto))
        .withColumn(
            "_fix",
            F.last(F.when(fixed, F.struct(F.col("_if_whole").alias("v"), F.col("_turns").alias("n"))),
                   ignorenulls=True).over(upto),
        )
        .withColumn("_tail", F.lead(F.lit(True), 1, False).over(here) == F.lit(False))
    )
    known = answer(F.col("_fix.v"), F.col("_turns") - F.col("_fix.n"))
    # one row per block speaks for it: a fixed answer, or the turns of the block
    tails = W.partitionBy(
        "seq_id", F.when(F.col("_tail"), F.lit(-1)).otherwise(F.col("_block"))
    ).orderBy(*order)
    tail_turn = F.when(F.col("_fix").isNull(), F.col("_turns") % 2).otherwise(F.lit(0))
    linked = (
        inside.withColumn("_tail_turns", F.sum(tail_turn).over(tails.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn(
            "_tail_fix",
            F.last(
                F.when(F.col("_fix").isNotNull(), F.struct(known.alias("v"), F.col("_tail_turns").alias("n"))),
                ignorenulls=True,
            ).over(tails.rowsBetween(W.unboundedPreceding, -1)),
        )
        .withColumn("_turned", F.lag("_tail_turns").over(tails))
    )
    handed = answer(F.col("_tail_fix.v"), F.col("_turned") - F.col("_tail_fix.n"))
    block_rows = W.partitionBy("seq_id", "_block")
    carried = linked.withColumn("_in", F.max(F.when(F.col("_tail"), handed)).over(block_rows))
    whole = F.coalesce(known, answer(F.col("_in"), F.col("_turns")))
    return carried.withColumn("_whole", whole)


def ranked_regions(regions: DataFrame, rule: Rule, block: int = BLOCK) -> DataFrame:
    """Ranked repeats from regions ``(seq_id, seq_name, k, motif, start_pos, length)``.

    One pass per motif length; each pass ends in the shared checkpoint folder.
    """
    spark = regions.sparkSession
    covered = spark.createDataFrame([], "seq_id long, start_pos long, end_pos long")
    reports = []
    for i, k in enumerate(rule.k_list):
        mine = regions.where(F.col("k") == k)
        span = F.col("length") - F.col("length") % k
        asked = mine.withColumn("_last", F.col("start_pos") + span - 1)
        seen = covering(asked, covered, "_last", block=block)
        inside = F.col("cover_end").isNotNull()
        # offset of the last free position of the first phase, and the first phase that
        # reaches a free position of the spare tail
        free = F.when(inside, F.col("cover_start") - 1 - F.col("start_pos")).otherwise(span - 1)
        later = F.when(
            inside & (F.col("cover_end") < F.col("start_pos") + F.col("length") - 1),
            F.col("cover_end") - F.col("_last") + 1,
        )
        states = seen.withColumn("_free", free).withColumn("_later", later).withColumn("_span", span)
        linked = previous(
            states, ["seq_id"], "start_pos", [F.col("start_pos").asc()],
            {"_p_start": F.col("start_pos"), "_p_span": F.col("_span"), "_p_later": F.col("_later")},
            block,
        )
        overlap = F.col("_p_start") + F.col("_p_span") - F.col("start_pos")
        own = linked.withColumn(
            "_if_whole", F.col("_free") >= F.greatest(F.coalesce(overlap, F.lit(0)), F.lit(0))
        ).withColumn(
            "_if_not",
            F.col("_free") >= F.greatest(F.coalesce(overlap + F.col("_p_later"), F.lit(0)), F.lit(0)),
        )
        settled = _settle_chain(own, block)
        shift = F.when(F.col("_whole"), F.lit(0)).otherwise(F.col("_later"))
        kept = settled.withColumn("_shift", shift).where(F.col("_shift").isNotNull())
        found = durable(as_repeats(kept, F.col("_shift")))
        reports.append(found)
        if i + 1 == len(rule.k_list):
            break
        covered = durable(
            merge_intervals(
                covered.unionByName(found.select("seq_id", "start_pos", "end_pos")), block=block
            )
        )
    out = reports[0]
    for more in reports[1:]:
        out = out.unionByName(more)
    return out


def ranked_repeats(df: DataFrame, rule: Rule, size: int = CHUNK_SIZE, block: int = BLOCK) -> DataFrame:
    """Exact repeats of competing motif lengths."""
    found, long = read_whole(df, size, ranked_reader(rule))
    if long is None:
        return found
    regions = exact_regions(long, rule.k_list, rule.min_repeat, rule.primitive_only, size, spread=spread_of(df))
    return found.unionByName(ranked_regions(durable(regions), rule, block))


def spread_of(df: DataFrame) -> int:
    """Partitions for the chunks of long sequences: the session's shuffle setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
