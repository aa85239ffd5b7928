"""Repeats with tolerated mismatches and gaps, and other rules that read in order.

Each unit is compared with the first unit of its run, and where reading goes on
depends on what was reported before, so the choice among repeats is a left to
right reading. A sequence that fits in one chunk is read in one go, where it is.

Longer sequences are read in ranges, in parallel. Every range is read with
context on both sides, beginning early, and notes the reading state at its two
borders. If the state one range ends with is the state the next one assumed,
both readings are what a single reading would have given. Where they differ, or
where a run leaves the context, just those two ranges are joined and read again,
until all borders agree.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.scan import Rule
from ..sources.chunks import CHUNK_SIZE, assemble, chunk_sequences
from .blocks import div, durable, join_few, previous
from .exact import REPEAT_COLUMNS, REPEAT_SCHEMA, RowSpans, cut_spanning_repeats, slices
from .intervals import merge_intervals, uncovered_intervals
from .linked import read_linked
from .resolve import cells_taken, read_whole, repeats_batch, spread_of

_READ_SCHEMA = (
    "seq_id long, seq_name string, lo long, hi long, kind string, k int, motif string, "
    "cnt long, start_pos long, end_pos long, state_in string, state_out string, sure boolean"
)
_READ_ARROW = pa.schema(
    [("seq_id", pa.int64()), ("seq_name", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()),
     ("kind", pa.string()), ("k", pa.int32()), ("motif", pa.string()), ("cnt", pa.int64()),
     ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("state_in", pa.string()),
     ("state_out", pa.string()), ("sure", pa.bool_())]
)


def ordered_reader(rule: Rule):
    """Task function: reads rows ``(seq_id, seq_name, chunk_start, chunk[, mask])`` in order."""

    def read(batches):
        for batch in batches:
            for part, texts in slices(batch, "chunk"):
                rows = RowSpans(texts)
                lanes = [scan.possible_starts(rows.codes, rows.stop, k, rule) for k in rule.k_list]
                cuts = [np.searchsorted(lane.start, np.append(rows.start, rows.stop[-1])) for lane in lanes]
                some = np.flatnonzero(sum(np.diff(cut) for cut in cuts))
                found = []
                for r in some.tolist():
                    text, origin = texts[r], part["chunk_start"][r].as_py()
                    starts = [
                        lane.pick(slice(cut[r], cut[r + 1])).moved(-int(rows.start[r]))
                        for lane, cut in zip(lanes, cuts)
                    ]
                    got = scan.scan_text(text, rule, taken=cells_taken(part, r, texts), starts=starts)
                    for k, p, cnt, end in got.rows:
                        found.append((r, k, text[p : p + k], cnt, p + origin, end + origin))
                if found:
                    yield repeats_batch(part, found)

    return read


def _state(marks, which: int, origin: int) -> str:
    """Reading state at one border, in positions of the sequence."""
    return ";".join(
        f"{lane[which][0] + origin},{lane[which][1] + origin if lane[which][1] >= 0 else ''}"
        for lane in marks
    )


def _read_ranges(texts: DataFrame, rule: Rule, context: int) -> DataFrame:
    """Read ranges ``(seq_id, seq_name, lo, hi, text_start, text)`` on their own."""

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                text, origin, lo, hi = row["text"], row["text_start"], row["lo"], row["hi"]
                goes_on = len(text) == hi + context - origin
                has_next = len(text) > hi - origin
                borders = [lo - origin, hi - origin] if has_next else [lo - origin]
                got = scan.scan_text(text, rule, borders, cut_short=goes_on)
                mine = [r for r in got.rows if lo <= r[1] + origin < hi]
                n = len(mine)
                states = [
                    _state(got.marks, 0, origin), _state(got.marks, 1, origin) if has_next else None,
                    got.certain_to >= hi - origin,
                ]
                # one row per repeat, then one for the range
                columns = [[row[c]] * (n + 1) for c in ("seq_id", "seq_name", "lo", "hi")]
                columns.append(["repeat"] * n + ["range"])
                columns.append([k for k, *_ in mine] + [None])
                columns.append([text[p : p + k] for k, p, *_ in mine] + [None])
                columns.append([cnt for _, _, cnt, _ in mine] + [None])
                columns.append([p + origin for _, p, *_ in mine] + [None])
                columns.append([end + origin for *_, end in mine] + [None])
                columns += [[None] * n + [state] for state in states]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _READ_ARROW)], schema=_READ_ARROW
                )

    return texts.mapInArrow(read, _READ_SCHEMA)


def _joined_ranges(edges: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(ranges to read again as one, starts of the ranges they replace)."""
    linked = previous(
        edges, ["seq_id"], "lo", [F.col("lo").asc()],
        {"_lo": F.col("lo"), "_out": F.col("state_out"), "_sure": F.col("sure")}, block=size << 10,
    )
    agrees = F.col("_sure") & F.col("_out").eqNullSafe(F.col("state_in"))
    bad = durable(linked.where(F.col("_lo").isNotNull() & ~agrees).select("seq_id", "seq_name", "_lo", "lo", "hi"))
    # one position is left out at the end, so that only ranges with a bad border touch
    spans = bad.select("seq_id", "seq_name", F.col("_lo").alias("start_pos"), (F.col("hi") - 2).alias("end_pos"))
    joined = merge_intervals(
        spans, ["seq_id", "seq_name"], block=size << 10, distinct_starts=False
    ).select("seq_id", "seq_name", F.col("start_pos").alias("lo"), (F.col("end_pos") + 2).alias("hi"))
    gone = bad.select("seq_id", "lo").union(bad.select("seq_id", "_lo")).distinct()
    return durable(joined), gone


_MOST_JOINED = 16  # ranges read again as one


def read_long(df: DataFrame, rule: Rule, size: int, context: int) -> DataFrame:
    """Repeats of long sequences, read in ranges of ``size`` that are checked against each other.

    Under ``every_start`` each start of a run is a report of its own, and ranges are joined whatever their length.
    """
    first = chunk_sequences(df, size, halo=context, left=context, spread=spread_of(df))
    start = F.col("chunk_start")
    ranges = first.select(
        "seq_id", "seq_name", start.alias("lo"), (start + size).alias("hi"),
        F.greatest(start - context, F.lit(0).cast("long")).alias("text_start"),
        F.col("chunk").alias("text"),
    )
    columns = ["seq_id", "seq_name", "lo", "hi", "state_in", "state_out", "sure"]
    rounds = [durable(_read_ranges(ranges, rule, context))]
    edges = rounds[0].where("kind = 'range'").select(*columns, F.lit(0).alias("round"))
    base = chunk_sequences(df, size)
    apart = []
    while True:
        joined, gone = _joined_ranges(edges, size)
        if joined.isEmpty():
            break
        if not rule.every_start:
            large = durable(joined.where(F.col("hi") - F.col("lo") > _MOST_JOINED * size).select("seq_id").distinct())
            if not large.isEmpty():
                apart.append(read_linked(join_few(df, large, "seq_id", "left_semi"), rule, size, context))
                edges = durable(join_few(edges, large, "seq_id", "left_anti"))
                joined, gone = (join_few(x, large, "seq_id", "left_anti") for x in (joined, gone))
        again = durable(_read_ranges(assemble(base, joined, size, context, context), rule, context))
        fresh = again.where("kind = 'range'").select(*columns, F.lit(len(rounds)).alias("round"))
        edges = durable(edges.join(gone, ["seq_id", "lo"], "left_anti").select(*columns, "round").unionByName(fresh))
        rounds.append(again)
    found = [r.where("kind = 'repeat'") for r in rounds]
    if len(rounds) == 1:
        return found[0].select(*REPEAT_COLUMNS)
    # what counts is the last reading of each range
    every = reduce(DataFrame.unionByName, [f.withColumn("round", F.lit(i)) for i, f in enumerate(found)])
    last = edges.select("seq_id", "lo", "round")
    every = every.join(last, ["seq_id", "lo", "round"], "left_semi").select(*REPEAT_COLUMNS)
    return reduce(DataFrame.unionByName, apart, every)


def tolerant_repeats(
    df: DataFrame, rule: Rule, size: int = CHUNK_SIZE, context: int | None = None
) -> DataFrame:
    """Repeats under any rule, also one with mismatches and gaps."""
    context = min(size, max(4096, 8 * rule.reach)) if context is None else context
    found, long = read_whole(df, size, ordered_reader(rule))
    return found if long is None else found.unionByName(read_long(long, rule, size, context))


# -- the run through a given position -----------------------------------------

_FEW_POSITIONS = 1_000_000  # 16 bytes each
_AROUND_SCHEMA = (
    "seq_id long, seq_name string, k int, motif string, pos long, cnt long, start_pos long, "
    "end_pos long, open boolean"
)
_AROUND_ARROW = pa.schema(
    [("seq_id", pa.int64()), ("seq_name", pa.string()), ("k", pa.int32()), ("motif", pa.string()),
     ("pos", pa.int64()), ("cnt", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64()),
     ("open", pa.bool_())]
)


def _runs_around(texts: DataFrame, rule: Rule, context: int) -> DataFrame:
    """Runs through ``asked`` positions; ``open`` marks those that reach the text's cut ends."""

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.select(["seq_id", "seq_name", "hi", "text_start", "text"]).slice(i, 1).to_pylist()[0]
                text, origin = row["text"], row["text_start"]
                goes_on = len(text) == row["hi"] + context - origin
                asked = batch["asked"][i].values
                found = []
                for pos, k in zip(asked.field("pos").to_pylist(), asked.field("k").to_pylist()):
                    if goes_on and pos - origin + k > len(text):  # not even the unit is in sight
                        found.append((k, None, pos, 0, pos, pos, True))
                        continue
                    run = scan.run_around(text, pos - origin, k, rule)
                    if run is None:
                        continue
                    start, cnt, end = run
                    open_ = (origin > 0 and start < rule.step + k) or (
                        goes_on and end + rule.step + k >= len(text)
                    )
                    if open_ or cnt >= rule.min_repeat:
                        motif = text[pos - origin : pos - origin + k]
                        found.append((k, motif, pos, cnt, start + origin, end + origin, open_))
                if found:
                    columns = [[row["seq_id"]] * len(found), [row["seq_name"]] * len(found), *zip(*found)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, _AROUND_ARROW)], schema=_AROUND_ARROW
                    )

    return texts.mapInArrow(read, _AROUND_SCHEMA)


def tolerant_at_position(
    df: DataFrame, positions: DataFrame, rule: Rule, size: int = 1 << 16, context: int = 4096
) -> DataFrame:
    """The run through each ``(seq_id, pos, k)`` with mismatches and gaps.

    A position asked twice is answered once. Positions are looked up in their
    chunk; those of runs that reach the end of its context are looked up again,
    together, with eight times as much context.
    """
    context = min(context, size)
    asked = (
        positions.select(
            F.col("seq_id").cast("long").alias("seq_id"), F.col("pos").cast("long").alias("pos"),
            F.col("k").cast("int").alias("k"), div("pos", size).alias("chunk_id"),
        )
        .where("pos >= 0")
        .groupBy("seq_id", "chunk_id")
        .agg(F.collect_set(F.struct("pos", "k")).alias("asked"))  # at most size positions per length
    )
    asked = durable(asked)
    total = asked.agg(F.sum(F.size("asked")).alias("n")).first()["n"] or 0
    asked = F.broadcast(asked) if total <= _FEW_POSITIONS else asked.hint("merge")
    chunks = chunk_sequences(df, size, halo=context, left=context)
    start = F.col("chunk_start")
    texts = chunks.join(asked, ["seq_id", "chunk_id"]).select(
        "seq_id", "seq_name", "asked", (start + size).alias("hi"),
        F.greatest(start - context, F.lit(0).cast("long")).alias("text_start"),
        F.col("chunk").alias("text"),
    )
    base = chunk_sequences(df, size)
    found = durable(_runs_around(texts, rule, context))
    done = [found.where("not open")]
    while not found.where("open").isEmpty():
        context *= 8
        # the open positions of a chunk share one text
        wanted = found.where("open").groupBy("seq_id", "seq_name", div("pos", size).alias("_chunk")).agg(
            F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"), F.collect_list(F.struct("pos", "k")).alias("asked")
        ).drop("_chunk")
        texts = assemble(base, wanted, size, context, context)
        found = durable(_runs_around(texts, rule, context))
        done.append(found.where("not open"))
    return reduce(DataFrame.unionByName, done).drop("open")


_SEEN = "struct<pos:bigint,seq_name:string,motif:string,cnt:bigint,start_pos:bigint,end_pos:bigint>"


def cut_spanning_runs(df: DataFrame, cuts: DataFrame, rule: Rule, **options) -> DataFrame:
    """Repeats that cover cut positions, with mismatches and gaps; columns of ``cut_spanning_repeats``.

    The runs through the windows of length k that hold a cut are taken from left
    to right, and one that begins within the one before, its last unit left out,
    is a rotation of it.
    """
    if rule.exact:
        return cut_spanning_repeats(df, cuts, rule.k_list, rule.min_repeat, rule.primitive_only)
    asked = cuts.select(F.col("seq_id").cast("long").alias("seq_id"), F.col("cut").cast("long").alias("cut")).distinct()
    windows = asked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in rule.k_list]))).withColumn(
        "pos", F.explode(F.sequence(F.greatest(F.col("cut") - F.col("k") + 1, F.lit(0)), F.col("cut")))
    )
    windows = durable(windows)
    runs = tolerant_at_position(df, windows.select("seq_id", "pos", "k").distinct(), rule, **options)
    near = windows.join(runs, ["seq_id", "pos", "k"])
    seen = F.struct("pos", "seq_name", "motif", "cnt", "start_pos", "end_pos")
    each = near.groupBy("seq_id", "cut", "k").agg(F.sort_array(F.collect_list(seen)).alias("runs"))  # at most k
    kept = F.aggregate(
        "runs",
        F.struct(F.lit(-1).cast("long").alias("right"), F.array().cast(f"array<{_SEEN}>").alias("kept")),
        lambda have, run: F.when(
            run["start_pos"] > have["right"],
            F.struct(
                (run["end_pos"] - F.col("k") + 1).alias("right"), F.concat(have["kept"], F.array(run)).alias("kept")
            ),
        ).otherwise(have),
        lambda have: have["kept"],
    )
    return each.select("seq_id", "cut", "k", F.explode(kept).alias("run")).select(
        "seq_id", "run.seq_name", "k", "cut", "run.motif", "run.cnt", "run.start_pos", "run.end_pos"
    )


def uncovered_runs(df: DataFrame, mask: DataFrame, rule: Rule, size: int = CHUNK_SIZE) -> DataFrame:
    """Repeats under any rule, each length on its own, with at least one position outside ``mask``."""
    return uncovered_intervals(tolerant_repeats(df, replace(rule, policy="separate"), size), mask)
