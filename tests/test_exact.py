"""Exact repeats: any chunk size, hot and long sequences, positions, cuts."""

import random

import model
import pytest
from helpers import expected, pieces, repeat_rows, sequences
from pyspark.sql import functions as F

from stutter import find_repeats, get_repeats, single_k_repeats
from stutter.functions.scan import Rule
from stutter.operators import blocks, exact, resolve, segments
from stutter.sources.chunks import chunk_sequences

TEXTS = model.texts(random.Random(11), 300) + ["", "a", "é" * 40, "ab" * 100, "N" * 500]


@pytest.fixture(scope="module")
def seqs(spark):
    return sequences(spark, TEXTS).cache()


@pytest.mark.parametrize("size", [6, 7, 32, 1 << 20])
def test_chunk_size_does_not_matter(spark, seqs, size):
    want = expected(TEXTS, (1, 2, 3, 6), policy="separate")
    assert repeat_rows(exact.chunked_repeats(seqs, (1, 2, 3, 6), size)) == want
    assert repeat_rows(exact.chunked_repeats(pieces(spark, TEXTS), (1, 2, 3, 6), size, spread=3)) == want


def test_every_chunk_in_a_task_of_its_own(spark):
    texts = ["abc" * n + tail for n in range(2, 9) for tail in ("", "a", "ab", "x")]
    frame = sequences(spark, texts)
    want = expected(texts, (2, 3), policy="separate")
    for size in (3, 6, 7):
        assert repeat_rows(exact.chunked_repeats(frame, (2, 3), size, spread=200)) == want


@pytest.mark.parametrize("min_repeat", [2, 4])
def test_min_repeat_and_any_motif(seqs, min_repeat):
    assert repeat_rows(exact.exact_repeats(seqs, (2, 3), min_repeat)) == expected(
        TEXTS, (2, 3), min_repeat, policy="separate"
    )
    every = repeat_rows(exact.exact_repeats(seqs, (2,), min_repeat, primitive_only=False))
    assert {r for r in every if model.primitive(r[2])} == set(expected(TEXTS, (2,), min_repeat, policy="separate"))
    assert any(not model.primitive(r[2]) for r in every)


@pytest.mark.parametrize("ks", [(1, 2, 3, 6), (6, 3, 2, 1, 4), (2, 2, 1)])
def test_ranked(spark, seqs, ks):
    want = expected(TEXTS, ks)
    assert repeat_rows(find_repeats(seqs, ks)) == want
    assert repeat_rows(find_repeats(pieces(spark, TEXTS), ks)) == want


@pytest.mark.parametrize("ks,size,block", [((1, 2, 6), 8, 8), ((6, 2, 1), 16, 32)])
def test_ranked_on_long_sequences(spark, seqs, ks, size, block):
    want = expected(TEXTS, ks)
    assert repeat_rows(resolve.ranked_repeats(seqs, Rule(ks), size, block)) == want


def test_shifted(seqs):
    got = repeat_rows(find_repeats(seqs, (2, 3, 4), policy="separate", every_start=True))
    assert got == expected(TEXTS, (2, 3, 4), policy="separate", every_start=True)
    assert len(got) > len(expected(TEXTS, (2, 3, 4), policy="separate"))


def test_short_forms(seqs):
    got = sorted(tuple(r) for r in single_k_repeats(seqs, 2).collect())
    assert got == sorted((f"seq{i}", m, c, s) for i, _, m, c, s, _ in expected(TEXTS, (2,)))
    both = get_repeats(seqs, (3, 2), policy="ranked").columns
    assert both == ["seq_name", "motif", "cnt", "start_pos"]


def test_position(spark, seqs):
    asked = [(i, p, k) for i, t in enumerate(TEXTS) for p in range(len(t)) for k in (1, 2, 3)]
    frame = spark.createDataFrame(asked, "seq_id long, pos long, k int")
    want = sorted((i, p, k, *run) for i, p, k in asked if (run := model.around(TEXTS[i], p, k)))
    for block in (4, 1 << 16):
        got = exact.repeat_at_position(seqs, frame, block=block)
        assert sorted((r.seq_id, r.pos, r.k, r.start_pos, r.cnt, r.end_pos) for r in got.collect()) == want
        assert all(r.motif == TEXTS[r.seq_id][r.pos : r.pos + r.k] for r in got.collect())


def test_position_with_many_regions(spark, seqs, monkeypatch):
    """Beyond the size of a broadcast, positions are folded before they are shuffled; each row asked is answered."""
    texts = [*TEXTS, "ab" * 300 + "x" + "abc" * 200]
    asked = [(i, p, k) for i, t in enumerate(texts) for p in range(len(t)) for k in (1, 2, 3)]
    asked += [r for r in asked if r[1] % 3 == 0] * 2 + [(0, -1, 2), (0, 10**9, 2)]
    want = sorted((i, p, k, *run) for i, p, k in asked if 0 <= p < len(texts[i]) and (run := model.around(texts[i], p, k)))
    frame = spark.createDataFrame(asked, "seq_id long, pos long, k int")
    frame = frame.unionByName(spark.createDataFrame([(None, 1, 2), (0, None, 2), (0, 1, None)], frame.schema))
    monkeypatch.setattr(blocks, "_FEW_BYTES", 0)
    got = exact.repeat_at_position(sequences(spark, texts), frame, k_list=(1, 2, 3))
    rows = got.collect()
    assert sorted((r.seq_id, r.pos, r.k, r.start_pos, r.cnt, r.end_pos) for r in rows) == want
    assert all(r.motif == texts[r.seq_id][r.pos : r.pos + r.k] for r in rows)
    # a row of the shuffle for each 256 positions of a sequence and length
    folded = exact._folded(frame.where("pos >= 0 and pos < 100000 and seq_id is not null and k is not null"))
    assert folded.count() == 3 * sum(-(-len(t) // 256) for t in texts)
    assert [f.dataType.typeName() for f in got.schema] == ["long", "string", "integer", "string", "long", "long", "long", "long"]


def _spanning(text, cut, ks):
    for k in ks:
        islands = {}
        for p in range(max(cut - k + 1, 0), min(cut, len(text) - k) + 1):
            run = model.around(text, p, k)
            if run is None:
                continue
            lo, hi = run[0], run[2] + 1  # widen to the region, which names the island
            while lo > 0 and text[lo - 1] == text[lo - 1 + k]:
                lo -= 1
            islands.setdefault(lo, (k, text[p : p + k], run[1], run[0], run[2]))
        yield from islands.values()


def test_cut_spanning(spark, seqs):
    cuts = [(i, c) for i, t in enumerate(TEXTS) for c in range(3, len(t), 5)]
    got = exact.cut_spanning_repeats(
        seqs, spark.createDataFrame(cuts, "seq_id long, cut long"), (1, 2, 3), block=16
    )
    want = sorted((i, c, *row) for i, c in cuts for row in _spanning(TEXTS[i], c, (1, 2, 3)))
    assert sorted((r.seq_id, r.cut, r.k, r.motif, r.cnt, r.start_pos, r.end_pos) for r in got.collect()) == want


def test_masked_segments(spark, seqs):
    size, ks = 16, (3, 2, 1)
    want = []
    for i, t in enumerate(TEXTS):
        border = {row for c in range(size, len(t), size) for row in _spanning(t, c, ks)}
        for o in range(0, len(t), size):
            part, covered = t[o : o + size], set()
            for k, motif, _, s, e in border:
                lo, hi = s - o, e - o
                cells = set(range(lo, hi + 1))
                if s <= o <= e:
                    for j in range(k - 1):
                        if hi + 1 + j >= len(part) or part[hi + 1 + j] != motif[j]:
                            break
                        cells.add(hi + 1 + j)
                if s <= o + len(part) - 1 <= e:
                    for j in range(1, k):
                        if lo - j < 0 or part[lo - j] != motif[-j]:
                            break
                        cells.add(lo - j)
                covered |= {c for c in cells if 0 <= c < len(part)}
            want += [(i, k, m, c, s + o, e + o) for k, m, c, s, e in model.read(part, ks, covered=covered)]
    rule = Rule(ks)
    assert repeat_rows(segments.masked_segment_scan(seqs, size, rule)) == sorted(want)
    assert repeat_rows(segments.masked_segment_scan(pieces(spark, TEXTS), size, rule)) == sorted(want)


def test_chunks_show_their_context(spark, seqs):
    for frame in (seqs, pieces(spark, TEXTS, 5)):
        rows = chunk_sequences(frame, 8, halo=3, left=4).collect()
        assert sorted((r.seq_id, r.chunk_id) for r in rows) == sorted(
            (i, c) for i, t in enumerate(TEXTS) for c in range(-(-len(t) // 8) or (1 if frame is seqs else 0))
        )
        for r in rows:
            t, o = TEXTS[r.seq_id], r.chunk_start
            assert r.chunk == t[max(o - 4, 0) : o + 8 + 3]
    for bad in (dict(size=0), dict(size=4, halo=5), dict(size=4, left=5)):
        with pytest.raises(ValueError):
            chunk_sequences(seqs, **bad)


def test_order_of_input_does_not_matter(seqs):
    want = expected(TEXTS, (2, 3), policy="separate")
    for n in (1, 5):
        assert repeat_rows(exact.exact_repeats(seqs.repartition(n, F.rand(n)), (2, 3))) == want


def test_only_border_runs_are_shuffled(seqs):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" not in plan(exact.exact_repeats(seqs, (2, 3)))
    cut = plan(exact.exact_repeats(seqs, (2, 3), size=16))
    assert cut.count("Exchange") == 2
    assert "CartesianProduct" not in cut and "NestedLoop" not in cut
