"""Exact repeats.

For a motif length k, let ``same(i)`` mean that characters i and i+k agree. A
maximal run of ``same`` from a, m long, is a region of m+k characters with
period k; each region with enough units and a primitive motif is one repeat.
Runs are found chunk by chunk without a shuffle and written once; only those that
touch a chunk border are then linked with their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.scalars import primitive_motif, rotate
from ..functions.scan import Rule
from ..sources.chunks import CHUNK_SIZE, chunk_sequences, is_pieces
from .blocks import div, durable_counted, join_few, weighed
from .intervals import merge_intervals, uncovered_intervals

REPEAT_COLUMNS = ["seq_id", "seq_name", "k", "motif", "cnt", "start_pos", "end_pos"]
_SLICE = 4 << 20  # characters looked at together in a task
_LOOKUP_BLOCK = 1 << 10  # positions that are compared with the regions near them
_WORDS = 4  # words of 64 positions in a row of folded positions

_RUN_SCHEMA = (
    "seq_id long, seq_name string, k int, motif string, start_pos long, end_pos long, border boolean"
)
_RUN_ARROW = pa.schema(
    [("seq_id", pa.int64()), ("seq_name", pa.string()), ("k", pa.int32()), ("motif", pa.string()),
     ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("border", pa.bool_())]
)
REPEAT_SCHEMA = (
    "seq_id long, seq_name string, k int, motif string, cnt long, start_pos long, end_pos long"
)
REPEAT_ARROW = pa.schema(
    [("seq_id", pa.int64()), ("seq_name", pa.string()), ("k", pa.int32()), ("motif", pa.string()),
     ("cnt", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64())]
)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with a bounded number of characters (or one row)."""
    texts = batch.column(column).to_pylist()
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if i > begin and held + len(text) > _SLICE:
            yield batch.slice(begin, i - begin), texts[begin:i]
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield batch.slice(begin), texts[begin:]


class RowSpans:
    """Several texts laid end to end."""

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        self.codes = scan.to_codes(self.text)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.stop = np.cumsum(lengths)
        self.start = self.stop - lengths

    def same(self, k: int, limit: int | None = None) -> np.ndarray:
        """``same`` flags, false where they would leave a row or its own ``limit`` characters."""
        flags = scan.same_after(self.codes, k)
        if flags.size == 0:
            return flags
        tails = (self.stop[:, None] - np.arange(1, k + 1)).ravel()
        flags[tails[(tails >= 0) & (tails < flags.size)]] = False
        if limit is not None:
            over = np.flatnonzero(self.stop - self.start > limit)
            if over.size:
                first, stop = self.start[over] + limit, self.stop[over]
                cells = first[:, None] + np.arange((stop - first).max())
                flags[cells[(cells < stop[:, None]) & (cells < flags.size)]] = False
        return flags


def _find_runs(batches, k_list, min_repeat, primitive_only, size):
    def of_slice(part: pa.RecordBatch, texts: list[str]):
        rows = RowSpans(texts)
        origin = np.asarray(part.column("chunk_start"), dtype=np.int64)
        more = np.flatnonzero(rows.stop - rows.start > size)
        inner = np.flatnonzero(origin > 0)
        out = ([], [], [], [], [], [])  # row, k, motif, first, last, at a border
        for k in k_list:
            flags = rows.same(k, size)
            first, length = scan.long_runs(flags, (min_repeat - 1) * k)
            runs = dict(zip(first.tolist(), length.tolist()))
            border = set()
            # runs at a chunk border may go on next door, so they count at any length
            for at, m in scan.border_runs(flags, rows.start[inner], rows.start[more] + size, size):
                runs[at] = m
                border.add(at)
            if not runs:
                continue
            at = np.fromiter(runs, np.int64, len(runs))
            row = np.searchsorted(rows.stop, at, side="right")
            for a, r in zip(at.tolist(), row.tolist()):
                motif = rows.text[a : a + k]
                if primitive_only and a not in border and not scan.is_primitive(motif):
                    continue
                begin = int(origin[r]) + a - int(rows.start[r])
                for cell, value in zip(out, (r, k, motif, begin, begin + runs[a] - 1, a in border)):
                    cell.append(value)
        take = pa.array(out[0], pa.int64())
        return pa.RecordBatch.from_arrays(
            [part.column("seq_id").take(take), part.column("seq_name").take(take),
             pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()),
             pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.bool_())],
            schema=_RUN_ARROW,
        )

    for batch in batches:
        for part, texts in slices(batch, "chunk"):
            found = of_slice(part, texts)
            if found.num_rows:
                yield found


def exact_regions(
    df: DataFrame,
    k_list,
    min_repeat: int = 3,
    primitive_only: bool = True,
    size: int = CHUNK_SIZE,
    spread: int | None = None,
) -> DataFrame:
    """Maximal periodic regions ``(seq_id, seq_name, k, motif, start_pos, length)``.

    The answer does not depend on ``size``: runs cut by a chunk border are linked
    before their length is judged. Chunks are at least as long as the longest motif.
    """
    rule = Rule(tuple(k_list), min_repeat)
    ks = tuple(dict.fromkeys(rule.k_list))
    size = max(size, *ks)

    def find(batches):
        return _find_runs(batches, ks, min_repeat, primitive_only, size)

    def runs_of(part: DataFrame, spread: int | None) -> tuple[DataFrame, int]:
        chunks = chunk_sequences(part, size, halo=max(ks), spread=spread)
        return durable_counted(chunks.mapInArrow(find, _RUN_SCHEMA), F.col("border"))

    if spread or is_pieces(df):
        runs, at_borders = runs_of(df, spread)
    else:  # strings of one chunk stay where they are, the chunks of longer ones are dealt out
        seen, is_long = Observation(), F.length("seq") > size
        runs, at_borders = runs_of(df.observe(seen, F.count_if(is_long).alias("long")).where(~is_long), None)
        if seen.get["long"]:
            tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            more, borders = runs_of(df.where(is_long), tasks)
            runs, at_borders = runs.unionByName(more), at_borders + borders
    length = F.col("end_pos") - F.col("start_pos") + 1
    columns = ["seq_id", "seq_name", "k", "motif", "start_pos", (length + F.col("k")).alias("length")]
    inside = runs.where("not border").select(*columns)
    if not at_borders:
        return inside
    # a block is a whole number of chunks, so that only chunk borders meet block borders
    linked = merge_intervals(
        runs.where("border"), ["seq_id", "seq_name", "k"], ["motif"],
        block=size * max(1, (1 << 26) // size), distinct_starts=False,
    )
    enough = length >= F.lit(min_repeat - 1) * F.col("k")
    return inside.unionByName(
        linked.where(enough & primitive_motif("motif", primitive_only)).select(*columns)
    )


def as_repeats(regions: DataFrame, shift: Column | None = None) -> DataFrame:
    """One repeat per region, beginning ``shift`` characters into it."""
    k, cnt = F.col("k").cast("long"), div("length", "k")
    start, motif = F.col("start_pos"), F.col("motif")
    if shift is not None:
        start, motif = start + shift.cast("long"), rotate("motif", shift)
    return regions.select(
        "seq_id", "seq_name", "k", motif.alias("motif"), cnt.alias("cnt"),
        start.alias("start_pos"), (start + cnt * k - 1).alias("end_pos"),
    )


def exact_repeats(
    df: DataFrame, k_list, min_repeat: int = 3, primitive_only: bool = True,
    size: int = CHUNK_SIZE, spread: int | None = None,
) -> DataFrame:
    """All exact repeats, every motif length on its own."""
    regions = exact_regions(df, k_list, min_repeat, primitive_only, size, spread)
    return as_repeats(regions)


def chunked_repeats(df: DataFrame, k_list, size: int, min_repeat: int = 3, **options) -> DataFrame:
    """:func:`exact_repeats` with a chosen chunk size; same rows for every size."""
    return exact_repeats(df, k_list, min_repeat, size=size, **options)


def shifted_repeats(df: DataFrame, k_list, min_repeat: int = 3, **options) -> DataFrame:
    """Every start that reaches a new cell: one row per phase of a region's spare tail."""
    regions = exact_regions(df, k_list, min_repeat, **options)
    spare = F.col("length") % F.col("k")
    each = regions.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), spare)))
    return as_repeats(each, F.col("_t"))


def uncovered_repeats(df: DataFrame, mask: DataFrame, k_list, min_repeat: int = 3, **options) -> DataFrame:
    """Repeats with at least one position outside ``mask``."""
    return uncovered_intervals(exact_repeats(df, k_list, min_repeat, **options), mask)


def regions_by_block(regions: DataFrame, block: int) -> DataFrame:
    last = F.col("start_pos") + F.col("length") - 1
    return regions.withColumn("_block", F.explode(F.sequence(div("start_pos", block), div(last, block))))


def repeat_at_position(
    df: DataFrame, positions: DataFrame, min_repeat: int = 3, primitive_only: bool = True,
    k_list=None, block: int = _LOOKUP_BLOCK, **options,
) -> DataFrame:
    """The exact repeat through each ``(seq_id, pos, k)``, seeded at that position.

    ``positions`` has columns seq_id, pos, k; positions without a repeat give no
    row. Joined by (seq_id, k, block of positions), so one long sequence spreads.
    Positions stay where they are while the regions are few; beyond that they
    are folded into bits before the shuffle.
    """
    if k_list is None:
        k_list = [r["k"] for r in positions.select("k").distinct().collect()]  # one row per motif length
    regions = exact_regions(df, k_list, min_repeat, primitive_only, **options)
    asked = positions.select(
        F.col("seq_id").cast("long").alias("seq_id"), F.col("pos").cast("long").alias("pos"),
        F.col("k").cast("int").alias("k"),
    )
    few, small = weighed(regions_by_block(regions, block))
    if not small:
        return _around(_folded_lookup(asked, regions), min_repeat)
    found = asked.withColumn("_block", div("pos", block)).join(F.broadcast(few), ["seq_id", "k", "_block"]).where(
        (F.col("pos") >= F.col("start_pos"))
        & (F.col("pos") + F.col("k") <= F.col("start_pos") + F.col("length"))
    )
    return _around(found, min_repeat)


def _folded(asked: DataFrame) -> DataFrame:
    """``seq_id, k, _block, _w0 ..., _n``: asked positions of a block as bits, and how many rows ask for them.

    Bits are set before the shuffle, so that a row is moved for a block and not for a position.
    """
    word = div("pos", 64) % _WORDS
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))
    words = [
        F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"_w{i}") for i in range(_WORDS)
    ]
    by = asked.where("pos >= 0").groupBy("seq_id", "k", div("pos", 64 * _WORDS).alias("_block"))
    return by.agg(*words, F.count("*").alias("_n"))


def _folded_lookup(asked: DataFrame, regions: DataFrame) -> DataFrame:
    """``asked`` with the regions through its positions; only folded positions and hits are shuffled.

    Hits in blocks that are asked for by more rows than positions are counted
    again in ``asked``, so a position asked twice is answered twice.
    """
    block = 64 * _WORDS
    near = _folded(asked).join(regions_by_block(regions, block).hint("merge"), ["seq_id", "k", "_block"])
    first = F.col("_block") * block
    low = F.greatest(first, F.col("start_pos"))
    high = F.least(first + (block - 1), F.col("start_pos") + F.col("length") - F.col("k"))
    near = near.where(low <= high).withColumn("pos", F.explode(F.sequence(low, high)))
    word = F.get(F.array(*[F.col(f"_w{i}") for i in range(_WORDS)]), (div("pos", 64) % _WORDS).cast("int"))
    hits = near.where(F.getbit(word, (F.col("pos") % 64).cast("int")) == 1)
    distinct = sum((F.bit_count(f"_w{i}") for i in range(_WORDS)), F.lit(0))
    hits = hits.select(
        "seq_id", "seq_name", "k", "motif", "start_pos", "length", "pos", (F.col("_n") > distinct).alias("_again")
    )
    hits, again = durable_counted(hits, F.col("_again"))
    once = hits.where("not _again").drop("_again")
    if not again:
        return once
    several = hits.where("_again").drop("_again")
    keys = ["seq_id", "k", "pos"]
    copies = join_few(asked, several.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("_copies"))
    each = several.join(copies, keys).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return once.unionByName(each.drop("_copies", "_copy"))


def _around(found: DataFrame, min_repeat: int) -> DataFrame:
    k = F.col("k").cast("long")
    before = div(F.col("pos") - F.col("start_pos"), k)
    after = div(F.col("start_pos") + F.col("length") - F.col("pos"), k)
    return (
        found.withColumn("_cnt", before + after)
        .where(F.col("_cnt") >= min_repeat)
        .select(
            "seq_id", "seq_name", "k",
            rotate("motif", (F.col("pos") - F.col("start_pos")) % k).alias("motif"),
            "pos", F.col("_cnt").alias("cnt"),
            (F.col("pos") - before * k).alias("start_pos"),
            (F.col("pos") + after * k - 1).alias("end_pos"),
        )
    )


def cut_spanning_repeats(
    df: DataFrame, cuts: DataFrame, k_list, min_repeat: int = 3, primitive_only: bool = True,
    block: int = _LOOKUP_BLOCK, **options,
) -> DataFrame:
    """Repeats that cover cut positions: one row per (cut, k, region).

    ``cuts`` has columns seq_id, cut. Of the windows of length k that hold the
    cut, the leftmost whose repeat has enough units speaks for its region; the
    other windows would only give rotations of it.
    """
    regions = exact_regions(df, k_list, min_repeat, primitive_only, **options)
    asked = cuts.select(
        F.col("seq_id").cast("long").alias("seq_id"), F.col("cut").cast("long").alias("cut")
    ).withColumn("_block", div("cut", block))
    k = F.col("k").cast("long")
    low = F.greatest(F.col("start_pos"), F.col("cut") - k + 1)
    high = F.least(F.col("cut"), F.col("start_pos") + F.col("length") - k)
    near = join_few(asked, regions_by_block(regions, block), ["seq_id", "_block"]).where(low <= high)
    # a window has length div k units, or one less where its phase is beyond length mod k
    phase, spare = (low - F.col("start_pos")) % k, F.col("length") % k
    enough = (div("length", k) > min_repeat) | (phase <= spare)
    leftmost = near.withColumn("pos", F.when(enough, low).otherwise(low + k - phase)).where(
        (div("length", k) >= min_repeat) & (F.col("pos") <= high)
    )
    before = div(F.col("pos") - F.col("start_pos"), k)
    after = div(F.col("start_pos") + F.col("length") - F.col("pos"), k)
    return leftmost.select(
        "seq_id", "seq_name", "k", "cut",
        rotate("motif", (F.col("pos") - F.col("start_pos")) % k).alias("motif"), (before + after).alias("cnt"),
        (F.col("pos") - before * k).alias("start_pos"), (F.col("pos") + after * k - 1).alias("end_pos"),
    )
