"""Mismatches and gaps, in one go and in ranges that are checked against each other."""

import random

import model
import pytest
from helpers import expected, pieces, repeat_rows, sequences

from stutter import find_repeats
from stutter.functions.scan import Rule
from stutter.operators.segments import border_repeats, masked_segment_scan, split_repeats
from stutter.operators.tolerant import cut_spanning_runs, tolerant_at_position, tolerant_repeats, uncovered_runs

TEXTS = model.texts(random.Random(3), 150, 160) + ["ab" * 200, "a" * 300 + "abc" * 60, "", "abcX" * 50]


@pytest.fixture(scope="module")
def seqs(spark):
    return sequences(spark, TEXTS).cache()


@pytest.mark.parametrize(
    "ks,miss,gap,policy", [((3, 2), 1, 1, "ranked"), ((2, 1), 0, 2, "separate"), ((1, 2, 3), 0, 1, "position")]
)
def test_whole(spark, seqs, ks, miss, gap, policy):
    want = expected(TEXTS, ks, 3, miss, gap, policy=policy)
    assert repeat_rows(find_repeats(seqs, ks, miss=miss, max_gap=gap, policy=policy)) == want
    assert repeat_rows(find_repeats(pieces(spark, TEXTS), ks, miss=miss, max_gap=gap, policy=policy)) == want


@pytest.mark.parametrize(
    "ks,miss,gap,policy,size,context",
    [((3, 2), 1, 1, "ranked", 40, 40), ((3,), 1, 0, "separate", 64, 16), ((2, 1), 0, 2, "position", 40, 32)],
)
def test_ranges(spark, seqs, ks, miss, gap, policy, size, context):
    want = expected(TEXTS, ks, 3, miss, gap, policy=policy)
    rule = Rule(ks, 3, miss, gap, policy=policy)
    assert repeat_rows(tolerant_repeats(seqs, rule, size, context)) == want
    assert repeat_rows(tolerant_repeats(pieces(spark, TEXTS), rule, size, context)) == want


def test_nothing_tolerated_is_exact(seqs):
    want = expected(TEXTS, (3, 2))
    assert repeat_rows(tolerant_repeats(seqs, Rule((3, 2)))) == want
    assert repeat_rows(find_repeats(seqs, (3, 2), max_gap=3, max_gaps=0)) == want


def test_gap_limit(seqs):
    few = repeat_rows(find_repeats(seqs, (2,), max_gap=2, max_gaps=1))
    assert few == expected(TEXTS, (2,), 3, 0, 2, 1)
    assert few != expected(TEXTS, (2,), 3, 0, 2)


@pytest.mark.parametrize("size,context", [(1 << 16, 4096), (32, 8)])
def test_position(spark, seqs, size, context):
    asked = [(i, p, k) for i, t in enumerate(TEXTS) for p in range(0, len(t), 3) for k in (2, 3)]
    frame = spark.createDataFrame(asked, "seq_id long, pos long, k int")
    got = tolerant_at_position(seqs, frame, Rule((3,), 3, 1, 1), size, context)
    want = sorted((i, p, k, *run) for i, p, k in asked if (run := model.around(TEXTS[i], p, k, 3, 1, 1)))
    assert sorted((r.seq_id, r.pos, r.k, r.start_pos, r.cnt, r.end_pos) for r in got.collect()) == want


@pytest.mark.parametrize(
    "ks,miss,gap,gaps,policy,every", [((3, 2), 1, 0, 9, "ranked", True), ((2, 1), 0, 2, 1, "separate", False),
                                      ((3, 2), 1, 1, 2, "position", False)],
)
def test_ranges_of_other_rules(spark, seqs, ks, miss, gap, gaps, policy, every):
    rule = Rule(ks, 3, miss, gap, gaps, policy=policy, every_start=every)
    want = expected(TEXTS, ks, 3, miss, gap, gaps, policy=policy, every_start=every)
    assert repeat_rows(tolerant_repeats(seqs, rule, 40, 40)) == want


def _over_cut(text, cut, ks, miss, gap):
    for k in ks:
        right = -1
        for p in range(max(cut - k + 1, 0), min(cut, len(text) - k) + 1):
            run = model.around(text, p, k, 3, miss, gap)
            if run is not None and run[0] > right:
                right = run[2] - k + 1
                yield (k, text[p : p + k], run[1], run[0], run[2])


@pytest.mark.parametrize("miss,gap", [(1, 1), (0, 2), (0, 0)])
def test_cuts(spark, seqs, miss, gap):
    rule = Rule((3, 2), 3, miss, gap)
    cuts = [(i, c) for i, t in enumerate(TEXTS) for c in range(8, len(t), 8)]
    got = cut_spanning_runs(seqs, spark.createDataFrame(cuts, "seq_id long, cut long"), rule)
    found = sorted((r.seq_id, r.cut, r.k, r.motif, r.cnt, r.start_pos, r.end_pos) for r in got.collect())
    assert found == sorted((i, c, *row) for i, c in cuts for row in _over_cut(TEXTS[i], c, (3, 2), miss, gap))


def test_border_of_a_tolerant_run(spark):
    frame = sequences(spark, ["abcabdabcabdabcabc"])
    rule = Rule((3,), 3, 1)
    border = repeat_rows(border_repeats(frame, 8, rule))
    assert (0, 3, "abc", 6, 0, 17) in border
    assert masked_segment_scan(frame, 8, rule).isEmpty()
    assert repeat_rows(split_repeats(frame, 8, rule)) == border


def test_uncovered(spark, seqs):
    rule = Rule((3, 2), 3, 1, 1)
    mask = find_repeats(seqs, (1,)).select("seq_id", "start_pos", "end_pos")
    hidden = {(r.seq_id, c) for r in mask.collect() for c in range(r.start_pos, r.end_pos + 1)}
    want = [row for row in expected(TEXTS, (3, 2), 3, 1, 1, policy="separate")
            if any((row[0], c) not in hidden for c in range(row[4], row[5] + 1))]
    assert repeat_rows(uncovered_runs(seqs, mask, rule)) == want
