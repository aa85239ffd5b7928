"""Coverage bitmaps against sets of positions."""

import pytest

from stutter.operators import bitmaps as bm
from stutter.operators import intervals as iv

SCHEMA = "seq_id long, start_pos long, end_pos long"
ONE = [(1, 0, 0), (1, 5, 12), (1, 9, 30), (1, 32760, 32775), (1, 32767, 32768), (2, 65535, 65535), (3, 100, 200_000), (3, 7, 7)]
TWO = [(1, 6, 8), (1, 32768, 40000), (3, 0, 99), (3, 150, 199_999), (4, 1, 2)]


def cells(rows):
    return {(s, p) for s, a, b in rows for p in range(a, b + 1)}


def read(df):
    out = set()
    for r in df.collect():
        assert len(r.bitmap) == bm.CELLS // 8
        out |= {(r.seq_id, r.block * bm.CELLS + 8 * i + j) for i, b in enumerate(r.bitmap) for j in range(8) if b >> j & 1}
    return out


@pytest.fixture(scope="module")
def masks(spark):
    return [bm.coverage_bitmaps(spark.createDataFrame(rows, SCHEMA)) for rows in (ONE, TWO)]


def test_cover(spark, masks):
    assert read(masks[0]) == cells(ONE)
    merged = iv.merge_intervals(spark.createDataFrame(ONE, SCHEMA)).collect()
    assert read(masks[0]) == cells([tuple(r) for r in merged])
    assert bm.coverage_bitmaps(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sets(masks):
    a, b = masks
    assert read(bm.union(a, b)) == cells(ONE) | cells(TWO)
    assert read(bm.without(a, b)) == cells(ONE) - cells(TWO)
    assert read(bm.without(b, a)) == cells(TWO) - cells(ONE)
    assert bm.without(a, a).count() == 0


def test_described(masks):
    rows = {(r.seq_id, r.block): r for r in bm.described(masks[0]).collect()}
    assert rows[1, 0].covered == 1 + 26 + 8 and rows[1, 0].density == 35 / 32768
    assert rows[1, 0].bits.startswith("E1FFFF7F00") and rows[1, 1].bits == "FF"
    assert rows[2, 1].bits == "00" * 4095 + "80"
    assert rows[3, 1].covered == 32768 and rows[3, 1].bits == "FF" * 4096


def test_positions_are_not_shuffled(masks, capsys):
    masks[0].explain("formatted")
    plan = capsys.readouterr().out
    assert "partial_bitmap_construct_agg" in plan
    assert plan.index("Generate") < plan.index("partial_bitmap_construct_agg")
