"""Run detection against a search of all periods at all places."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest

from stutter.llm import queries
from stutter.llm.periodic_runs import lyndon_lengths, periodic_runs

EXTRA = "doc_id long, text string, runs string, n_words string, collapsed_text int, w string, h int"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", "x", 1, "x", 1) for d, t in rows], EXTRA).repartition(3)


def longest_lyndon_word(s, i):
    words = (s[i:j] for j in range(len(s), i, -1))
    return next(len(w) for w in words if all(w < w[k:] for k in range(1, len(w))))


def test_lyndon_lengths():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(14))]
        assert lyndon_lengths(np.array(s, int)).tolist() == [longest_lyndon_word(s, i) for i in range(len(s))]


def phrases(rng, size, letters):
    w = []
    while len(w) < size:
        w += [rng.choice(letters) for _ in range(rng.randrange(1, 10))] * rng.randrange(1, 6)
    return w


ODD = [(None, None), (None, "a b " * 20), (90, None), (91, ""), (92, " \n\t "), (93, "one"), (93, "one"), (94, "é　 " * 30), (95, "same\v" * 24), (96, "same " * 23)]


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (4, 2), (9, 4)])
def test_periodic_runs(spark, least, times):
    rng = random.Random(least)
    rows = [(i, rng.choice([" ", "\n "]).join(phrases(rng, rng.randrange(80), "abc"))) for i in range(120)] + ODD
    got = periodic_runs(docs(spark, rows), least=least, times=times).collect()
    have = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in got]
    want = []
    for doc, text in rows:
        w = brute.words(text)
        runs = brute.runs(w, least, times)
        want.append((doc, len(w), runs, " ".join(brute.collapsed(w, runs))))
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert sum(len(r[2]) for r in want) > 20


def test_long_text(spark):
    rng = random.Random(5)
    unit = [f"w{rng.randrange(4000)}" for _ in range(9_000)]
    w = unit * 40 + ["end"] + ["x"] * 50_000 + unit[::-1] * 12  # some MB in one text
    (row,) = periodic_runs(docs(spark, [(1, " ".join(w))])).collect()
    assert [tuple(x) for x in row.runs] == [(0, 360_000, 9_000), (360_001, 50_000, 1), (410_001, 108_000, 9_000)]
    assert row.collapsed_text == " ".join([*unit, "end", "x", *unit[::-1]])


def test_empty_table(spark):
    assert periodic_runs(docs(spark, [])).collect() == []


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(phrases(rng, rng.randrange(200), "abcdefgh"))) for i in range(400)] + ODD
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect())))
    want = []
    for doc, text in rows:
        w = brute.words(text)
        h = None if doc is None else zlib.crc32(str(doc).encode())
        if h is not None and h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute.runs(w, 24, 3)
        first = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=(None,) * 3)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in
                  ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(brute.collapsed(w, runs)))]
        want.append((doc, len(runs), *first, runs and 1000 * first[1] // first[2] or None, *digest))
    assert got == sorted(map(repr, want))
