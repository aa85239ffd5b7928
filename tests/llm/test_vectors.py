"""Near-duplicate vectors against all pairs."""

import math
import random

import numpy as np
import pytest

from stutter.llm import near_vectors as operator
from stutter.llm import shared
from stutter.llm.near_vectors import Hashes, _rotated, linked, meets, near_vectors, tables_for

EXTRA = "vec_id long, embedding array<double>, key string, n string, place string, component string, v string"


def table(spark, rows, kind="double"):
    made = [(i, v, *["x"] * 5) for i, v in rows]
    return spark.createDataFrame(made, EXTRA.replace("double", kind)).repartition(3)


def brute(rows, least=0.9):
    rows = list(rows)
    ok = [i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v) for i, v in rows]
    width = max([len(v) for _, v in rows if v], default=0)
    units = []
    for (_, v), good in zip(rows, ok, strict=True):
        x = np.array([*v, *[0.0] * (width - len(v))]) if good else np.zeros(width)
        x = x / np.abs(x).max() if good else x
        units.append(x / np.linalg.norm(x) if good else x)
    label = list(range(len(rows)))
    count = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and units[i] @ units[j] >= least:
                count[i], count[j] = count[i] + 1, count[j] + 1
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    lo = {x: min((r[0] for r, y in zip(rows, label, strict=True) if y == x and r[0] is not None), default=None) for x in set(label)}
    return sorted(((i, c, lo[x], None if i is None else i == lo[x]) for (i, _), c, x in zip(rows, count, label, strict=True)), key=repr)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def groups(seed, size, width, spread, clear=True):
    """Vectors around some centres, with no cosine close to the threshold."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < size:
        centre = rng.normal(size=width)
        centre /= np.linalg.norm(centre)
        for _ in range(rng.integers(1, 12)):
            x = centre * rng.uniform(0.5, 9) + rng.normal(size=width) * 0.0
            out.append(x + np.linalg.norm(x) * spread * rng.normal(size=width) / math.sqrt(width))
    x = np.array(out[:size])
    if clear:
        u = x / np.linalg.norm(x, axis=1)[:, None]
        s = np.abs(u @ u.T - 0.9) < 0.03
        x = x[~np.triu(s, 1).any(axis=0)]
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)) * 3, x, strict=True)]


def odd(v):
    return [(None, v), (None, None), (9000, None), (9001, [0.0] * len(v)), (9002, [1.0, None]), (9003, [float("nan")]), (9004, []),
            (9005, v), (9005, v), (9006, [1e-310 * round(c * 1e6) for c in v]), (9007, [c * 1e300 for c in v]), (9008, [*v[:-1], float("inf")]),
            (9009, [2.0]), (9010, [5.0, 0.0]), (5, [-1.0, 0.0, -0.0])]


@pytest.mark.parametrize("width,spread", [(3, 0.1), (20, 0.15), (64, 0.2)])
def test_near_vectors(spark, width, spread):
    rows = groups(width, 260, width, spread)
    rows += odd(rows[0][1])
    got = found(near_vectors(table(spark, rows)))
    assert got == brute(rows)
    assert sum(r[1] > 0 for r in got) > 50


def test_small_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(shared, "FEW_BYTES", 0)
    monkeypatch.setattr(operator, "_PAIRS", 50)
    rows = groups(8, 300, 16, 0.15)
    rows += odd(rows[0][1])
    assert found(near_vectors(table(spark, rows), load=20, block=7)) == brute(rows)


def test_single_precision(spark):
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in groups(9, 80, 12, 0.1)]
    assert found(near_vectors(table(spark, rows, "float"))) == brute(rows)


def test_chain(spark):
    turn = math.acos(0.95)  # each is linked to its neighbours only
    rows = [(1000 - i, [math.cos(i * turn), math.sin(i * turn), 0.0]) for i in range(9)]
    got = found(near_vectors(table(spark, rows)))
    assert got == brute(rows)
    assert {r[2] for r in got} == {992} and sum(r[1] for r in got) == 16


def test_empty_table(spark):
    assert near_vectors(table(spark, [])).collect() == []
    assert found(near_vectors(table(spark, [(1, None), (2, [0.0])]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_rotation_keeps_angles():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(10, 32))
    y = _rotated(x, rng.choice([-1.0, 1.0], (3, 32)))
    assert np.allclose(x @ x.T, y @ y.T)


@pytest.mark.parametrize("parts", [1, 2])
def test_recall_at_the_threshold(parts):
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(2, 3000, 48))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b = 0.9 * a + math.sqrt(0.19) * b / np.linalg.norm(b, axis=1)[:, None]
    hashes = Hashes(48, parts, tables_for(48, parts, 0.9, 0.004))
    assert meets(hashes.of(a), hashes.of(b)).any(axis=1).mean() > 0.99


def test_each_pair_counts_once():
    rng = random.Random(4)
    codes = np.array([[[rng.randrange(5) for _ in range(1)] + rng.sample(range(5, 9), 3) for _ in range(3)] for _ in range(40)], np.uint8)
    x, n = np.ones((40, 2)) / math.sqrt(2), np.ones(40, np.int64)
    total = np.zeros(40, np.int64)
    for t in range(3):
        for bucket in range(9):
            here = np.flatnonzero((codes[:, t] == bucket).any(axis=1))
            total[here] += linked(x[here], n[here], codes[here], t, bucket, 0, 0.9)[0]
    want = [[meets(codes[i], codes[j]).any() for j in range(40) if j != i] for i in range(40)]
    assert total.tolist() == [sum(w) for w in want]
