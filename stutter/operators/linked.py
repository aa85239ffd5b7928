"""Reading in order over any number of ranges, with runs of any length.

Every range is read at once, from a guess of what reading has come to at its
left border. A run that leaves the text of its range is not read on in one
place: all segments it may cross tell what they do to a run of its unit in any
phase, these passages are composed from right to left, and the run's end is
looked up. Then the ranges of a sequence are gone through by their states alone:
those behind a long run are passed over, and those whose guess was wrong are
read again from the right state, until all borders agree.

Text is only ever in rows of a range with its context. What is gathered for one
sequence is a state of a few numbers for each of its ranges.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import carry, scan
from ..functions.scan import Rule
from ..sources.chunks import chunk_sequences
from .blocks import div, durable
from .exact import REPEAT_COLUMNS, RowSpans, slices
from .intervals import merge_intervals

_AHEAD = 4096  # segments looked at in one go behind an open run at most
_ROWS = 1 << 14  # rows handed on together
_KEY = "k int, seed string, gap int, used long, stop long"
_KEYS = ["k", "seed", "gap", "used", "stop"]
_STATE = "struct<pos:bigint,reach:bigint,free:bigint>"
_STATE_ARROW = pa.struct([("pos", pa.int64()), ("reach", pa.int64()), ("free", pa.int64())])


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows."""
    while some := list(itertools.islice(rows, _ROWS)):
        yield _batch(some, schema)


def _each(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[dict]:
    """Rows of batches, a bounded number of characters at a time."""
    for batch in batches:
        for part, _ in slices(batch, column):
            yield from part.to_pylist()


# -- texts of ranges --------------------------------------------------------------


def _shown(df: DataFrame, size: int, context: int) -> DataFrame:
    """Ranges with their context on both sides and one character more, written once for all rounds of all lengths."""
    chunks = chunk_sequences(df, size, halo=context + 1, left=context)
    before = F.least(F.col("chunk_start"), F.lit(context)).cast("int").alias("before")
    return durable(chunks.select("seq_id", "seq_name", "chunk_id", "chunk_start", before, "chunk"))


# -- ends of runs that leave their range ----------------------------------------

_OPEN = "seq_id long, id long, " + _KEY + ", units long"
_DONE = "seq_id long, id long, units long, end_pos long"
_AFTER = _OPEN + ", ended boolean, seg long"


def run_ends(shown: DataFrame, wanted: DataFrame, rule: Rule, size: int, context: int) -> DataFrame:
    """``(seq_id, k, seed, gap, used, stop, units, end_pos)``: what runs in these states still add, and their last position.

    A state lies within the last ``rule.step`` characters of a range's context.
    Segments are the ranges moved by that much, so that runs enter each of them
    within its first few characters.
    """
    spark, step = shown.sparkSession, rule.step
    shift = context - step + 1
    texts = shown.select(
        "seq_id", F.col("chunk_id").alias("seg"), F.expr(f"substr(chunk, before + {shift + 1})").alias("text"),
        (F.length("chunk") - F.col("before") == size + shift + step).alias("cut"),
    )
    wanted = durable(wanted.select("seq_id", *_KEYS).distinct().withColumn("id", F.monotonically_increasing_id()))
    waiting = wanted.select("seq_id", "id", *_KEYS, F.lit(0).cast("long").alias("units"))
    after = _arrow(_AFTER, spark)

    def stepped(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            begin = row["seg"] * size + shift
            for s in row["states"]:
                units, at, gap, used, ended = carry.walk(
                    row["text"], s["stop"] - begin, s["seed"], s["gap"], s["used"], rule, row["cut"], size
                )
                yield row["seq_id"], s["id"], s["k"], s["seed"], gap, used, at + begin, s["units"] + units, ended, row["seg"] + 1

    def step_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each state through the segment it stands in."""
        return _batches(stepped(_each(batches, "text")), after)

    passages = _arrow("seq_id long, seed string, seg long, passage binary", spark)

    def passed(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            for seed in row["seeds"]:
                through = carry.passage(row["text"], seed, rule, size, step, row["cut"])
                yield row["seq_id"], seed, row["seg"], through.packed()

    def pass_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(passed(_each(batches, "text")), passages)

    met = _arrow("seq_id long, id long, gap int, used long, stop long, units long, ended boolean", spark)

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        """States of one unit in one sequence, taken as far as the passages at hand go."""
        at_segment: dict[int, list[dict]] = {}
        for s in left.to_pylist():
            at_segment.setdefault(s["seg"], []).append(s)
        rows, behind, last = [], None, None
        for p in sorted(right.select(["seg", "passage"]).to_pylist(), key=lambda x: -x["seg"]):
            seg = p["seg"]
            here = carry.Passage.unpacked(p["passage"], step, rule)
            # an ended run's position is turned into one of the sequence
            here.at = np.where(here.ended, here.at + seg * size + shift, here.at)
            if behind is None or last != seg + 1:
                behind, out_at = here, np.full(here.at.shape, seg + 1)
            else:
                go = ~here.ended
                at, c = np.where(go, here.at, 0), here.gap + 1
                out_at = np.where(go, out_at[c, at], seg + 1)
                behind = carry.composed(here, behind)
            last = seg
            for s in at_segment.get(seg, ()):
                c = carry.SHUT if s["used"] >= rule.max_gaps else s["gap"]
                o = s["stop"] - seg * size - shift
                cell = (c + 1, o)
                used = s["used"] + int(behind.used[cell])
                if used > rule.max_gaps:  # the limit is met on the way; the next step finds where
                    rows.append((s["seq_id"], s["id"], s["gap"], s["used"], s["stop"], s["units"], False))
                    continue
                ended = bool(behind.ended[cell])
                stop = int(behind.at[cell]) + (0 if ended else int(out_at[cell]) * size + shift)
                gap = s["gap"] if c == carry.SHUT else int(behind.gap[cell])
                rows.append((s["seq_id"], s["id"], gap, used, stop, s["units"] + int(behind.units[cell]), ended))
        return pa.Table.from_batches([_batch(rows, met)])

    done = []
    for turn in itertools.count():
        asked = waiting.withColumn("seg", div(F.col("stop") - shift, size))
        asked = asked.groupBy("seq_id", "seg").agg(F.collect_list(F.struct("id", *_KEYS, "units")).alias("states"))
        moved = durable(texts.join(asked, ["seq_id", "seg"]).mapInArrow(step_on, _AFTER))
        done.append(moved.where("ended").select("seq_id", "id", "units", (F.col("stop") - 1).alias("end_pos")))
        waiting = moved.where("not ended")
        if waiting.isEmpty():
            break
        # behind runs that are still open, ever more segments are looked at
        ahead = F.explode(F.sequence(F.col("seg"), F.col("seg") + min(4**turn, _AHEAD) - 1)).alias("seg")
        seeds = waiting.select("seq_id", "seed", ahead).groupBy("seq_id", "seg").agg(F.collect_set("seed").alias("seeds"))
        known = texts.join(seeds, ["seq_id", "seg"]).mapInArrow(pass_through, "seq_id long, seed string, seg long, passage binary")
        both = waiting.groupBy("seq_id", "seed").cogroup(known.groupBy("seq_id", "seed"))
        taken = durable(both.applyInArrow(
            compose, "seq_id long, id long, gap int, used long, stop long, units long, ended boolean"
        ))
        done.append(taken.where("ended").select("seq_id", "id", "units", (F.col("stop") - 1).alias("end_pos")))
        waiting = taken.where("not ended").join(wanted.select("id", "k", "seed"), "id").select("seq_id", "id", *_KEYS, "units")
        if waiting.isEmpty():
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return durable(wanted.join(every.drop("seq_id"), "id").drop("id"))


# -- ranges that hand their state on ---------------------------------------------

_ENTRY = f"struct<{', '.join(x.replace(' ', ':', 1) for x in _KEY.split(', '))},units:bigint,end_pos:bigint,free:bigint>"
_READ = (
    "seq_id long, seq_name string, lane int, chunk_id long, kind string, k int, motif string, cnt long, start_pos long, "
    f"end_pos long, entered {_STATE}, left {_STATE}, seed string, gap int, used long, stop long"
)


def _read(ranges: DataFrame, rule: Rule, lanes: list[list[int]], size: int, context: int, schema: pa.Schema) -> DataFrame:
    """Read rows ``(seq_id, seq_name, lane, chunk_id, text, text_start, state, mask, ends)``."""

    as_state = lambda s: s and dict(zip(("pos", "reach", "free"), s, strict=True))

    def starts_of(rows: list[dict]) -> list[list[scan.Starts]]:
        """Starts in each text by length, looked for in all texts of a lane together."""
        out: list[list[scan.Starts]] = [[] for _ in rows]
        for lane in {row["lane"] for row in rows}:
            mine = [i for i, row in enumerate(rows) if row["lane"] == lane]
            spans = RowSpans([rows[i]["text"] for i in mine])
            for k in lanes[lane]:
                found = scan.possible_starts(spans.codes, spans.stop, k, rule)
                cut = np.searchsorted(found.start, np.append(spans.start, spans.stop[-1])).tolist()
                for j, i in enumerate(mine):
                    out[i].append(found.pick(slice(cut[j], cut[j + 1])).moved(-int(spans.start[j])))
        return out

    def of_rows(rows: list[dict]) -> Iterator[tuple]:
        for row in rows:
            state, lo = row["state"], row["chunk_id"] * size
            row["state"] = state and tuple(state[c] for c in ("pos", "reach", "free"))
            if state:  # what lies before the range has been read
                row["text"], row["text_start"] = row["text"][lo - row["text_start"] :], lo
        for row, starts in zip(rows, starts_of(rows), strict=True):
            text, origin = row["text"], row["text_start"]
            lo = row["chunk_id"] * size
            hi = lo + size
            ends = {
                tuple(e[c] for c in _KEYS): (e["units"], e["end_pos"], e["free"]) for e in row["ends"] or ()
            }
            mask = sorted((m["s"], m["e"]) for m in row["mask"] or ())
            got = carry.read_range(
                text, origin, lo, hi, lanes[row["lane"]], starts, rule, row["state"], origin + len(text) == hi + context,
                mask, ends,
            )
            base = (row["seq_id"], row["seq_name"], row["lane"], row["chunk_id"])
            for k, p, cnt, end in got.rows:
                yield (*base, "repeat", k, text[p - origin : p - origin + k], cnt, p, end, *[None] * 6)
            for k, seed, gap, used, stop in dict.fromkeys(got.wanted):
                yield (*base, "wanted", k, *[None] * 6, seed, gap, used, stop)
            yield (*base, "range", *[None] * 5, as_state(got.entered), as_state(got.left), *[None] * 4)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in slices(batch, "text"):
                yield from _batches(of_rows(part.to_pylist()), schema)

    return ranges.mapInArrow(read, _READ)


_PLAN = f"seq_id long, lane int, chunk_id long, valid boolean, again boolean, state {_STATE}"


def _planned(ranges: DataFrame, size: int, schema: pa.Schema) -> DataFrame:
    """Go through the ranges of each sequence by their states: which count, and which are read again from where.

    Rows stream by in order, so that a task holds the state of one range only.
    """

    def planned(rows: Iterator[dict]) -> Iterator[tuple]:
        now = None
        for r in rows:
            base = (r["seq_id"], r["lane"], r["chunk_id"])
            if base[:2] != now:
                now, known, skip = base[:2], {"pos": 0, "reach": -1, "free": 0}, 0
            if r["chunk_id"] < skip:
                yield (*base, False, False, None)
                continue
            wrong = known is not None and r["entered"] != known
            state = known if known is not None else r["entered"]
            # what is not known yet is believed until its left neighbour says otherwise
            yield (*base, True, wrong or (r["left"] is None and r["asked"]), state)
            known = r["left"]
            skip = known["pos"] // size if known else 0

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(planned(row for batch in batches for row in batch.to_pylist()), schema)

    placed = ranges.repartition("seq_id", "lane").sortWithinPartitions("seq_id", "lane", "chunk_id")
    return placed.mapInArrow(plan, _PLAN)


def read_linked(df: DataFrame, rule: Rule, size: int, context: int) -> DataFrame:
    """Repeats of long sequences under any rule, in rows of bounded size.

    ``ranked`` lengths are read one after the other, each with the cells of those
    before it covered; else all are read at once.
    """
    context = max(context, rule.reach + rule.step)
    size = max(size, context + 1)
    shown = _shown(df, size, context)
    if rule.policy == "ranked":
        found = None
        for k in rule.k_list:
            mask = None if found is None else durable(merge_intervals(found, ["seq_id"], block=size))
            mine = _linked(shown, rule, [[k]], size, context, mask)
            found = mine if found is None else durable(found.unionByName(mine))
        return found
    lanes = [list(rule.k_list)] if rule.policy == "position" else [[k] for k in rule.k_list]
    return _linked(shown, rule, lanes, size, context, None)


def _linked(shown: DataFrame, rule: Rule, lanes: list[list[int]], size: int, context: int, mask: DataFrame | None) -> DataFrame:
    spark = shown.sparkSession
    schema, plan_schema = _arrow(_READ, spark), _arrow(_PLAN, spark)
    texts = shown.select(
        "seq_id", "seq_name", "chunk_id", (F.col("chunk_start") - F.col("before")).alias("text_start"),
        F.expr(f"substr(chunk, 1, before + {size + context})").alias("text"),
    )
    if mask is not None:  # cut at ranges, with the context of each and the cell behind it
        first = F.greatest(F.lit(0), div(F.col("start_pos") - context - 1, size))
        cut = mask.select("seq_id", F.col("start_pos").alias("s"), F.col("end_pos").alias("e"), F.explode(
            F.sequence(first, div(F.col("end_pos") + context, size))).alias("chunk_id"))
        per_range = cut.groupBy("seq_id", "chunk_id").agg(F.collect_list(F.struct("s", "e")).alias("mask"))
        texts = texts.join(per_range, ["seq_id", "chunk_id"], "left")
    else:
        texts = texts.withColumn("mask", F.lit(None).cast("array<struct<s:bigint,e:bigint>>"))
    first = texts.withColumn("lane", F.explode(F.array(*[F.lit(i) for i in range(len(lanes))])))
    first = first.withColumn("state", F.when(F.col("chunk_id") == 0, F.lit(None)).cast(_STATE)).withColumn(
        "ends", F.lit(None).cast(f"array<{_ENTRY}>")
    )
    at_start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(-1).cast("long").alias("reach"), F.lit(0).cast("long").alias("free"))
    first = first.withColumn("state", F.when(F.col("chunk_id") == 0, at_start))
    keys = ["seq_id", "lane", "chunk_id"]
    rounds = [durable(_read(first, rule, lanes, size, context, schema))]
    version = lambda frame, n: frame.where("kind = 'range'").select(*keys, "entered", "left", F.lit(n).alias("round"))
    ranges, ends = version(rounds[0], 0), None
    while True:
        now = rounds[-1].where("kind = 'wanted'").select("seq_id", "lane", "chunk_id", *_KEYS)
        asked = now.select(*keys).distinct().withColumn("asked", F.lit(True))
        plan = ranges.join(asked, keys, "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        plan = durable(_planned(plan, size, plan_schema))
        again = plan.where("again").select(*keys, "state")
        if again.isEmpty():
            break
        now = durable(now.join(again.select(*keys), keys, "left_semi"))
        if not now.isEmpty():
            resolved = run_ends(shown, now, rule, size, context)
            # the first cell after the end that is not covered beforehand
            after = F.col("end_pos") + 1
            if mask is None:
                resolved = resolved.withColumn("free", after)
            else:
                inside = cut.select("seq_id", "chunk_id", "s", "e").where(
                    (F.col("e") >= F.col("chunk_id") * size) & (F.col("s") < (F.col("chunk_id") + 1) * size)
                )
                resolved = resolved.withColumn("chunk_id", div(after, size)).join(inside, ["seq_id", "chunk_id"], "left").groupBy(
                    "seq_id", *_KEYS, "units", "end_pos"
                ).agg(F.max(F.when((F.col("s") <= after) & (F.col("e") >= after), F.col("e") + 1)).alias("covered"))
                resolved = resolved.withColumn("free", F.coalesce("covered", after)).drop("covered")
            fresh = now.join(resolved, ["seq_id", *_KEYS]).select(*keys, *_KEYS, "units", "end_pos", "free")
            ends = durable(fresh if ends is None else ends.unionByName(fresh))
        wanted = again
        if ends is not None:
            listed = ends.groupBy(*keys).agg(F.collect_list(F.struct(*_KEYS, "units", "end_pos", "free")).alias("ends"))
            wanted = again.join(listed, keys, "left")
        else:
            wanted = wanted.withColumn("ends", F.lit(None).cast(f"array<{_ENTRY}>"))
        rounds.append(durable(_read(texts.join(wanted, ["seq_id", "chunk_id"]), rule, lanes, size, context, schema)))
        fresh = version(rounds[-1], len(rounds) - 1)
        ranges = durable(ranges.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh))
    counts = ranges.select(*keys, "round").join(plan.where("valid").select(*keys), keys)
    found = rounds[0].where("kind = 'repeat'").withColumn("round", F.lit(0))
    for i, r in enumerate(rounds[1:], 1):
        found = found.unionByName(r.where("kind = 'repeat'").withColumn("round", F.lit(i)))
    return durable(found.join(counts, [*keys, "round"], "left_semi").select(*REPEAT_COLUMNS))
