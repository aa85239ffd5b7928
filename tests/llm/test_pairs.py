"""Operators that compare documents, against brute force and on odd rows."""

import itertools
import random

import brute
import numpy as np
import pytest

from stutter.llm import decontamination, jaccard_join, line_chunks, shared, substring_dedup, topk
from stutter.llm.shared import connected

# names that the operators use inside, of other types
EXTRA = "doc_id long, text string, bucket string, h string, digest string, gone string, row string, item_id string, words int, n string, component int"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, *["x"] * 6, 1, "x", 1) for d, t in rows], EXTRA).repartition(3)


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


ODD = [(None, None), (None, "a b c"), (90, None), (91, ""), (92, " \n\t "), (93, "one"), (93, "one"), (94, "é " * 70)]


def texts(seed, size, copies=3):
    """Documents with shared passages at odd places, exact and near copies."""
    rng = random.Random(seed)
    passage = prose(rng, size)
    out = []
    for i in range(14):
        w = prose(rng, rng.randrange(10, 160))
        if i % 2:
            at = rng.randrange(len(w))
            w[at:at] = passage[rng.randrange(5) : size - rng.randrange(5)]
        out.append((i * 3, rng.choice([" ", "  ", "\n"]).join(w)))
    for k in range(copies):
        out.append((100 + k, out[k][1]))
        w = brute.words(out[k][1])
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "new"
        out.append((200 + k, " ".join(w)))
    out += [(300, "same " * 120), (301, "same " * 90), (302, "Same " * 90), (7, "w1 " * 55), (8, "w1 " * 50), (9, "w1 " * 49)]
    return out


@pytest.mark.parametrize("size", [49, 55, 90])
def test_substring_dedup(spark, size):
    rows = texts(size, size) + ODD
    got = substring_dedup.substring_dedup(docs(spark, rows))
    kept = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()]
    assert sorted(kept, key=repr) == sorted(brute.substring_dedup(rows), key=repr)


@pytest.mark.parametrize("few", [0, 300])
def test_without_broadcasts_and_with_split_buckets(spark, monkeypatch, few):
    monkeypatch.setattr(shared, "FEW_BYTES", few)
    monkeypatch.setattr(shared, "BUCKET", 2)
    rows = texts(2, 70, 2) + near_copies(3, 8) + ODD
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute.substring_dedup(rows), key=repr)
    got = [tuple(r) for r in jaccard_join.jaccard_join(docs(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute.jaccard_components(rows), key=repr)
    cut = line_chunks.line_dedup(docs(spark, rows)).select("doc_id", "n_removed", "kept_text").collect()
    monkeypatch.setattr(shared, "FEW_BYTES", 1 << 24)
    same = line_chunks.line_dedup(docs(spark, rows)).select("doc_id", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, cut), key=repr) == sorted(map(tuple, same), key=repr)


def test_cover():
    d, v = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % v for a in d for b in d} == set(range(v))
    assert substring_dedup.ANCHOR + v - 1 == substring_dedup.WINDOW


def near_copies(seed, n=30):
    rng = random.Random(seed)
    base = [prose(rng, 80) for _ in range(4)]
    out = []
    for i in range(n):
        w = list(base[i % 4])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(999)}"
        out.append((1000 - i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    return out


@pytest.mark.parametrize("region", [jaccard_join.REGION, 700])
def test_jaccard_join(spark, region):
    rows = near_copies(region) + texts(1, 60) + ODD[:-3] + [(93, "one"), (95, "ONE"), (96, "a b c d"), (97, "a b c d e")]
    got = [tuple(r) for r in jaccard_join.jaccard_join(docs(spark, rows), region=region).collect()]
    assert sorted(got, key=repr) == sorted(brute.jaccard_components(rows), key=repr)


def test_region_splits_into_cells(monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    rows = near_copies(5, 60)
    sets = [np.unique([hash(s) & (1 << 63) - 1 for s in brute.shingles(t)]).astype(np.uint64) for _, t in rows]
    region = jaccard_join.Region([d for d, _ in rows], sets)
    region.join(np.arange(len(rows)))
    want = {doc: label for doc, _, label in brute.jaccard_components(rows)}
    groups: dict = {}
    for (doc, _), c in zip(rows, region.component, strict=True):
        groups.setdefault(c, []).append(doc)
    assert {min(g): sorted(g) for g in groups.values()} == {
        label: sorted(d for d in want if want[d] == label) for label in set(want.values())
    }


def test_connected(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (500, 501), (501, 500), (9, 9)]
    got = {r.node: r.component for r in connected(spark, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(1, 41), 100], 1), 500: 500, 501: 500}
    assert connected(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_masks_cover_all_substitutions():
    for size, allowed in ((13, 2), (8, 1)):
        for bad in itertools.combinations(range(size), allowed):
            assert any(
                not {s + k for k in m} & set(bad) for m in decontamination.MASKS for s in range(size - m[-1])
            )


@pytest.mark.parametrize("few", [decontamination.FEW_BYTES, 0])
def test_contamination(spark, monkeypatch, few):
    monkeypatch.setattr(decontamination, "FEW_BYTES", few)
    rng = random.Random(3)
    items = [(i, " ".join(prose(rng, n)).title()) for i, n in enumerate((40, 20, 13, 12, 8, 7))] + [(8, None), (9, "")]
    rows = [(i, " ".join(prose(rng, 90))) for i in range(12)] + ODD
    for i, (_, body) in enumerate(items[:6]):
        for k in (0, 1, 2, 3, 6):
            w = body.upper().split()
            for at in rng.sample(range(len(w)), min(k, len(w))):
                w[at] = "other"
            rows.append((400 + 10 * i + k, " ".join(prose(rng, 30)) + " -- " + ", ".join(w) + "!"))
    rows.append((500, items[0][1][20:]))
    rows.append((400, "the id again"))
    items += [(20, "Solitary"), (21, "two of"), (22, "機械学習の試験問題です"), (23, "漢字"), (24, "ข้อสอบ"), (25, "一二三四五六七八九十百千万"), (26, "--")]
    rows += [(600 + i, t) for i, t in enumerate((
        "a solitary one, solitary", "of two", "one, two OF them", "two. of", "序文機械学習の試験問題です。終", "機械学習の模験問題です", "漢", "x漢字x",
        "ไทย ข้อสอบ", "零一二三X五六七八九十百千万", "一二X四X六X八九十百千万", "two  -- ", "solitar", "two " * 300 + "of " * 300,
    ))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = decontamination.contamination(docs(spark, rows), bench).collect()
    want = [(d, len(brute.tokens(t)), brute.contaminated(t, items)) for d, t in rows]
    assert sorted(((r.doc_id, r.n_tokens, r.item_ids or []) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.contaminated == bool(r.item_ids) for r in got)
    first = {r.doc_id: [tuple(o) for o in r.overlaps] for r in got if r.doc_id in (600, 613)}
    assert first == {600: [(20, 1, 2)], 613: [(21, 299, 301)]}
    kept = decontamination.decontaminated(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns
    assert kept.count() == sum(not w[2] for w in want)
    none = bench.where("false")
    assert decontamination.contamination(docs(spark, rows), none).where("contaminated").count() == 0
    assert decontamination.contamination(docs(spark, []), bench).count() == 0


def test_line_dedup(spark):
    rng = random.Random(4)
    line = lambda: " ".join(prose(rng, rng.randrange(1, 6)))
    passage = [line() for _ in range(12)]
    rows = []
    for i in range(12):
        own = [line() for _ in range(rng.randrange(0, 9))]
        rows.append((i, "\n".join(own[:3] + passage[i % 3 :] + own[3:])))
    rows += [*ODD, (20, "\n\n\n\n\n\n"), (21, "\n\n\n\n\n\n"), (22, rows[3][1]), (22, rows[3][1]), (23, "\n".join(passage * 3))]
    got = line_chunks.line_dedup(docs(spark, rows)).collect()
    seen, want = {}, []
    big = (1 << 63) - 1
    keyed = sorted(((big if d is None else d, t) for d, t in rows if t is not None), key=lambda x: x[0])
    for d, t in keyed:
        for first, n, chunk in line_chunks._chunks(t):
            if n >= 2 and chunk.strip():
                seen.setdefault(chunk, (d, t, first))
    for d, t in rows:
        kept, removed = [], 0
        for first, n, chunk in line_chunks._chunks(t):
            place = (big if d is None else d, t, first)
            if chunk in seen and n >= 2 and seen[chunk] != place:
                removed += n
            else:
                kept.append(chunk)
        want.append((d, removed, None if t is None else b"\n".join(kept).decode()))
    assert sorted(((r.doc_id, r.n_removed, r.kept_text) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 60
    assert line_chunks.line_dedup(docs(spark, [])).count() == 0
    cut = line_chunks.without_repeats(docs(spark, rows))
    assert cut.columns == docs(spark, rows).columns and cut.count() == len(rows)


def whole_lines(rows):
    """Numbers of lines removed and texts left, comparing every place with every earlier one."""
    order = sorted({(d, t) for d, t in rows if t is not None})
    gone = {}
    for k, (d, t) in enumerate(order):
        lines = t.split("\n")
        out = gone[d, t] = set()
        for d0, t0 in order[: k + 1]:
            other = lines if (d0, t0) == (d, t) else t0.split("\n")
            for i in range(len(lines)):
                for j in range(min(len(other), i) if other is lines else len(other)):
                    n = 0
                    while i + n < len(lines) and j + n < len(other) and lines[i + n] == other[j + n] and (
                        other is not lines or j + n < i):
                        n += 1
                    if n > 1 and "".join(lines[i : i + n]).strip():
                        out.update(range(i, i + n))
    return [(d, len(gone.get((d, t), ())), None if t is None else "\n".join(
        x for i, x in enumerate(t.split("\n")) if i not in gone[d, t])) for d, t in rows]


def test_whole_line_dedup_leaves_no_repeated_run(spark, monkeypatch):
    rng = random.Random(14)
    line = lambda: " ".join(prose(rng, rng.randrange(12, 30)))
    common = line()
    rows = []
    for k in range(12):  # passages of 2 to 5 lines between lines of their own
        passage = [line() for _ in range(2 + k % 4)]
        if k % 3 == 0:
            passage[1:1] = ["", "", ""]
        for c in range(3):
            own = [line() for _ in range(rng.randrange(5))] + [common]
            rows.append((10 * k + c, "\n".join(own[:2] + passage + own[2:])))
    rows += [(500, rows[4][1]), (500, rows[4][1]), (501, rows[4][1] + "\n" + rows[8][1]), (502, "\n".join([common, "x"])),
             (503, "\n".join([line(), line()] * 4)), (504, "\n".join(["same"] * 5)), (505, "\n\n\n\n"), (506, "\n\n\n\n"),
             (507, ""), (508, None), (509, "a\r\nb\r\nc"), (510, "a\r\nb\r\nd"), (511, "a\nb\nd")]
    want = sorted(whole_lines(rows), key=repr)
    assert sum(w[1] for w in want) > 80
    for few in (shared.FEW_BYTES, 100):
        monkeypatch.setattr(shared, "FEW_BYTES", few)
        got = line_chunks.line_dedup(docs(spark, rows), whole=True).collect()
        assert sorted(((r.doc_id, r.n_removed, r.kept_text) for r in got), key=repr) == want
    left = line_chunks.without_repeats(docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, left), key=repr) == sorted(((d, t) for d, _, t in want), key=repr)
    assert line_chunks.line_dedup(docs(spark, []), whole=True).count() == 0


def test_chunk_borders_find_their_place_again():
    rng = random.Random(8)
    lines = [f"line {rng.random()}".encode() for _ in range(200)]
    whole = {tuple(lines[a:b]) for a, b in itertools.pairwise(line_chunks.chunk_bounds(lines))}
    put = lines[:50] + [b"put in"] + lines[50:]
    after = {tuple(put[a:b]) for a, b in itertools.pairwise(line_chunks.chunk_bounds(put))}
    assert len(whole - after) <= 3


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=20).round(3).tolist()) for i in range(160)]
    rows += [(i, rows[3][1]) for i in range(200, 230)] + [(300, rows[3][1])]  # ties
    rows += [(350, None), (351, [1.0, None]), (352, [float("nan")]), (353, [float("inf")]), (400, [0.5]), (450, []), (None, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, key string").repartition(3)
    for size in (topk.CANDIDATES, 40):
        assert sorted(tuple(r) for r in topk.top_k(df, candidates=size).collect()) == brute.top_k(rows)
    assert topk.top_k(df.where("vec_id is null")).count() == 0


@pytest.mark.parametrize("few", [
    [(0, [1.0]), (1, [2.0]), (50, [1e13, 1.0])],
    [(0, [94906267.0, 1.0]), (1, [94906267.0, 0.0]), (2, [94906267.0, 1.0]), (3, [-94906267.0, 2.5])],
    [(0, [1e30, 1.0]), (1, [1e30, 3.0]), (2, [-1e30, 3.0]), (3, [1.0, 1.0]), (50, [1e308, -1e308])],
    [(0, [1.5, 2.0])] * 9 + [(0, [3.5, 2.0])] * 2 + [(4, [1.5, 2.0])],  # equal rows, and one id with two vectors
])
def test_top_k_of_large_numbers_and_equal_rows(spark, few):
    small = spark.createDataFrame(few, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(tuple(r) for r in topk.top_k(small).collect()) == brute.top_k(few)
