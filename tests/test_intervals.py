"""Interval operators against sets of positions."""

import random

import pytest

from stutter.operators import intervals as iv
from stutter.operators.blocks import number_rows, previous
from pyspark.sql import functions as F

RND = random.Random(2)
ROWS = [
    (s, a, a + RND.randint(0, 30), RND.randint(1, 6), RND.choice("abcd"))
    for s in (0, 1, 2, 7) for a in [RND.randint(0, 400) for _ in range(60)]
] + [(9, 5, 200, 1, "a"), (9, 5, 200, 1, "a"), (9, 201, 260, 2, "b")]
ROWS = list(dict.fromkeys(ROWS)) + [ROWS[-3]]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "seq_id long, start_pos long, end_pos long, k int, motif string").cache()


def union(rows):
    out = {}
    for s, a, b, *_ in rows:
        out.setdefault(s, set()).update(range(a, b + 1))
    return out


def as_intervals(cells):
    out = []
    for s, taken in cells.items():
        for p in sorted(taken):
            if out and out[-1][0] == s and out[-1][2] == p - 1:
                out[-1][2] = p
            else:
                out.append([s, p, p])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("block", [4, 16, 1 << 20])
def test_merge_and_cover(spark, frame, block):
    got = iv.merge_intervals(frame, block=block)
    assert sorted(tuple(r) for r in got.collect()) == as_intervals(union(ROWS))
    points = spark.createDataFrame([(s, p) for s in (0, 1, 9, 11) for p in range(0, 450)], "seq_id long, p long")
    held = {(r.seq_id, r.p): (r.cover_start, r.cover_end) for r in iv.covering(points, got, "p", block=block).collect()}
    assert len(held) == 4 * 450
    wanted = as_intervals(union(ROWS))
    for (s, p), span in held.items():
        assert span == next(((a, b) for t, a, b in wanted if t == s and a <= p <= b), (None, None))


def test_uncovered(spark, frame):
    mask = [r for r in ROWS if r[3] > 3]
    cells = union(mask)
    m = spark.createDataFrame(mask, frame.schema)
    want = sorted(r for r in ROWS if not set(range(r[1], r[2] + 1)) <= cells.get(r[0], set()))
    assert sorted(tuple(r) for r in iv.uncovered_intervals(frame, m).select(*frame.columns).collect()) == want


@pytest.mark.parametrize("block", [7, 64])
def test_overlap_and_clip(spark, frame, block):
    segs = [(s, o, o + 24) for s in (0, 1, 2, 9, 12) for o in range(0, 500, 25)]
    left = spark.createDataFrame(segs, "seq_id long, seg_start long, seg_end long")
    distinct = frame.distinct()
    pairs = sorted(
        (s, a, b, r[1], r[2], r[3], r[4]) for s, a, b in segs for r in set(ROWS) if r[0] == s and r[1] <= b and r[2] >= a
    )
    inner = iv.overlap_join(left, distinct, block, "inner")
    cols = ["seq_id", "seg_start", "seg_end", "start_pos", "end_pos", "k", "motif"]
    assert sorted(tuple(r) for r in inner.select(*cols).collect()) == pairs
    clipped = iv.clip_intervals(inner).select("seg_start", "seg_end", "start_pos", "end_pos", "clip_start", "clip_end")
    assert all(r[4] == max(r[0], r[2]) and r[5] == min(r[1], r[3]) for r in clipped.collect())
    outer = iv.overlap_join(left, distinct, block)
    assert outer.count() == len(pairs) + len(set(segs) - {p[:3] for p in pairs})


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0], r[1], -r[2], -r[3], r[4]))


def test_drop_contained(frame):
    once = frame.distinct()
    rows = ordered(set(ROWS))
    per, glob, running = [], [], []
    for i, r in enumerate(rows):
        before = rows[i - 1] if i else None
        same = before is not None and before[0] == r[0]
        if not same or r[2] > before[2]:
            per.append(r)
        if r[2] > (before[2] if before else 0):
            glob.append(r)
        far = [q[2] for q in rows[:i] if q[0] == r[0]]
        if not far or r[2] > max(far):
            running.append(r)
    for got, want in (
        (iv.drop_contained(once), per), (iv.drop_contained_global(once), glob),
        (iv.drop_contained(once, running=True), running),
    ):
        assert ordered(tuple(r) for r in got.collect()) == want
    assert len({len(per), len(glob), len(running)}) > 1


@pytest.mark.parametrize("block", [3, 50, 1 << 20])
def test_previous(frame, block):
    once = frame.distinct()
    got = previous(once, ["seq_id"], "start_pos", iv.report_order(), {"p": F.col("end_pos")}, block)
    rows = ordered(set(ROWS))
    want = {r: (rows[i - 1][2] if i and rows[i - 1][0] == r[0] else None) for i, r in enumerate(rows)}
    assert {tuple(r)[:5]: r.p for r in got.collect()} == want


def test_number_rows(spark):
    # one key holds most rows
    rows = [(0 if i % 4 else i % 7, RND.random(), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "key long, x double, i long").repartition(7)
    got = {r.i: r.n for r in number_rows(df, ["key"], ["x", "i"], "n").collect()}
    by_key = {}
    for key, x, i in sorted(rows):
        by_key.setdefault(key, []).append(i)
    assert got == {i: n for ids in by_key.values() for n, i in enumerate(ids)}
    assert sorted(r.n for r in number_rows(df, [], ["x", "i"], "n").collect()) == list(range(5000))


def test_global_containment_with_sparse_ids(spark):
    rng = random.Random(12)
    ids = [rng.randrange(1 << 62) for _ in range(60)]
    rows = ordered({(i, *r[1:]) for i, r in zip([rng.choice(ids) for _ in ROWS], ROWS, strict=False)})
    want = [r for i, r in enumerate(rows) if r[2] > (rows[i - 1][2] if i else 0)]
    df = spark.createDataFrame(rows, "seq_id long, start_pos long, end_pos long, k int, motif string").repartition(4)
    for block in (4, 1 << 16):
        assert ordered(tuple(r) for r in iv.drop_contained_global(df, block).collect()) == want


def test_partial_units_of_a_long_motif(spark):
    unit = "".join(RND.choice("acgt") for _ in range(100_000))
    other = "x" if unit[70_000] != "x" else "y"
    rows = [
        (unit[:99_999], 300_000, 399_998, unit, 0, 299_999),  # a border repeat and nearly a unit behind it
        (unit[:70_000] + other + unit[70_001:], 300_000, 399_999, unit, 0, 299_999),
        ("ab" + "cd" * 3, 0, 7, "cd", 2, 9), ("adcd", 0, 3, "cd", 2, 9), ("é", 0, 0, "é", 0, 5),
    ]
    pairs = spark.createDataFrame(rows, "chunk string, seg_start long, seg_end long, motif string, start_pos long, end_pos long")
    # text behind the repeat begins with the segment here
    got = [(r.ext_before, r.ext_after) for r in iv.partial_unit_extension(pairs.coalesce(1)).collect()]
    want = []
    for chunk, a, b, motif, s, e in rows:
        after = chunk[max(e - a + 1, 0) :][: len(motif) - 1]
        before = chunk[: max(s - a, 0)][::-1][: len(motif) - 1]
        n = lambda u, t: next((i for i, (x, y) in enumerate(zip(u, t)) if x != y), min(len(u), len(t)))
        want.append((n(motif[::-1], before) if e >= b and s <= b else 0, n(motif, after) if s <= a <= e else 0))
    assert got == want
