"""Operators that look at one document at a time, sharding, packing and the pipeline."""

import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_pairs import ODD, docs, near_copies, prose, texts
from tokenizers import Tokenizer

import corpus_pipeline
from stutter.llm import language_id, packing, quality, sharding, token_counts, tokens

FOLDER = "/root/testdata/sf0.001"
TRICKY = [
    "", " ", "  lead", "trail  ", "a  b", "x\n y\n\nz", "<|endoftext|> and foo<|endoftext|>bar <|startoftext|>",
    "a\xa0b \xa0c 　 d", "é ́x", "it's  don't 12345 \xbd", "tab\tq \t r", "\x1c a\x1cb", "日本語 テキスト です",
    "ΑΣ ΑΣ.", "a \x85b", "İstanbul ǅ", "x" * 5000, "emoji 😀 👩‍👧 z", "  x ​q", "a   b", "#!? $5 (ok)",
]


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("seed", [1, 2])
def test_encoders_equal_the_library(seed):
    rng = np.random.default_rng(seed)
    alphabet = list("ab é'1.,!  \n\t\xa0　日") + ["<|endoftext|>", "́", "'s", " word", "<|", "ß", "×", "\x1c", "\x85", "ǅ", "\r", "\x0b"]
    made = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(400)] + TRICKY
    word, byte = tokenizer("word_bpe_49k.json"), tokenizer("byte_bpe_50k.json")
    counter, encoder = tokens.Counter("word_bpe_49k.json", 50), tokens.Encoder("byte_bpe_50k.json", 50)
    for lo in range(0, len(made), 37):
        part = made[lo : lo + 37]
        raw = [t.encode() for t in part]
        assert counter.counts(raw).tolist() == [len(word.encode(t, add_special_tokens=False).ids) for t in part]
        ids, n = encoder.encode(raw)
        want = [byte.encode(t, add_special_tokens=False).ids for t in part]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]


def test_token_counts(spark):
    word = tokenizer("word_bpe_49k.json")
    rows = [*ODD, *enumerate(TRICKY), (500, "word " * 2048), (501, "word " * 2049)]
    got = token_counts.token_counts(docs(spark, rows)).collect()
    want = []
    for d, t in rows:
        n = len(word.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 2048))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert [r.over_limit for r in got if r.doc_id in (500, 501)].count(True) == 1
    assert token_counts.token_counts(docs(spark, [])).count() == 0


def packed_right(rows, pieces, length=2048):
    """Pieces hold every id of every document once, and sequences have no gaps."""
    byte = tokenizer("byte_bpe_50k.json")
    found, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        found[p.doc_id, p.doc_tokens].append((p.start, p.length, p.ids_crc32))
        sequences[p.sequence_id].append((p.offset, p.length))
    want = defaultdict(list)
    for d, t in rows:
        ids = [*byte.encode(t or "", add_special_tokens=False).ids, 1]
        for s, n, _ in {x for x in found[d, len(ids)]}:
            want[d, len(ids)].append((s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
        spans = sorted({(s, n) for s, n, _ in found[d, len(ids)]})
        assert sum(n for _, n in spans) == len(ids) and [s for s, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    used = 0
    for at in sequences.values():
        end = 0
        for offset, n in sorted(at):
            assert offset == end
            end += n
        assert end <= length
        used += end
    return used / (length * len(sequences))


def test_packing(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["lorem"] * int(n))) for i, n in enumerate(rng.integers(1, 3000, 200))]
    rows += [*ODD, *((1000 + i, t) for i, t in enumerate(TRICKY)), (2000, "x " * 9000)]
    for group in (packing.GROUP, 40):
        full = packed_right(rows, packing.pack_documents(docs(spark, rows), group=group).collect())
    assert packed_right(rows, packing.pack_documents(docs(spark, rows)).collect()) > 0.98
    assert full > 0.9
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_first_fit():
    rng = np.random.default_rng(6)
    sizes = np.sort(rng.integers(1, 101, 300))[::-1]
    sequence, offset = packing.first_fit(sizes, 100)
    room = []
    for size, s, o in zip(sizes, sequence, offset, strict=True):
        first = next((i for i, r in enumerate(room) if r >= size), len(room))
        if first == len(room):
            room.append(100)
        assert (s, o) == (first, 100 - room[first])
        room[first] -= size
    assert len(packing.first_fit(sizes[:0], 100)[0]) == 0


def test_sharding(spark):
    rows = [*((i, f"t{i}") for i in range(2000)), *ODD, (5, "t5"), (5, "t5")]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows
    )
    slots, keys = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        keys[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert all(len(k) == 1 for k in keys.values())
    moved = sum(r.grown_shard == 8 for r in got) / len(got)
    assert 0.07 < moved < 0.16
    heavy = sharding.shard_documents(docs(spark, rows), weights={0: 3.0, 7: 1.0}, grown={0: 3.0}).collect()
    assert 0.7 < sum(r.shard == 0 for r in heavy) / len(heavy) < 0.8 and {r.grown_shard for r in heavy} == {0}
    assert sharding.shard_documents(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of([F.lit(1)], {0: 0.0})


def test_language_id(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = docs(spark, [*ODD, (600, "12 34 !?"), (601, "½ _ ²"), (602, "日本"), (603, "der die und")]).select(
        "doc_id", "text", F.lit(None).cast("string").alias("lang"), "words"
    )
    rows = table.select("doc_id", "text", "lang", F.lit(1).alias("words"))
    got = language_id.language_id(rows.unionByName(odd)).collect()
    assert len(got) == table.count() + odd.count()
    lang = {r.doc_id: r.lang for r in table.collect()}
    held = [r for r in got if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got if r.doc_id in (600, 601, 602, 603)}
    assert [by[i].lang_pred for i in (600, 601)] == ["und", "und"] and by[603].lang_pred == "de"
    assert by[602].lang_pred in set(lang.values())
    untaught = language_id.language_id(odd).collect()
    assert {r.lang_pred for r in untaught} == {"und"} and {r.score for r in untaught} == {0.0}
    assert language_id.language_id(odd.where("false")).count() == 0
    kept = language_id.identified(rows.unionByName(odd))
    assert kept.columns == ["doc_id", "text", "lang", "words"]
    assert kept.count() == sum(r.lang_pred != "und" for r in got)
    kept = kept.collect()
    given = {(r.doc_id, r.text): r.lang for r in table.where("lang is not null and text is not null").collect()}
    assert len(set(given.values())) == 4 and set(given) <= {(r.doc_id, r.text) for r in kept}  # clean texts of each language
    pred = {(r.doc_id, r.lang_pred) for r in got}
    filled = [r for r in kept if (r.doc_id, r.text) not in given and r.doc_id != 602]
    assert filled and all(r.lang is None or (r.doc_id, r.lang) in pred for r in filled) and any(r.lang == "de" for r in filled if r.doc_id == 603)
    assert all(r.lang == given[r.doc_id, r.text] for r in kept if (r.doc_id, r.text) in given)
    assert [r.lang for r in kept if r.doc_id == 602] == [None]  # nothing is known of 日本
    sure = language_id.identified(rows.unionByName(odd), guesses=False).collect()
    assert 602 not in {r.doc_id for r in sure} and set(given) <= {(r.doc_id, r.text) for r in sure}


@pytest.mark.parametrize("rarest", [language_id.RAREST, 200])
def test_languages_as_scored_by_hand(spark, monkeypatch, rarest):
    monkeypatch.setattr(language_id, "RAREST", rarest)
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in table.collect()] + [(9001, "ünder thé straße", None), (9002, "日本 the", None), (9003, "qx" * 3000, None)]
    taught = [(t, la) for d, t, la in rows if la is not None and t is not None and zlib.crc32(str(d).encode()) % 3 != 1]
    got = language_id.language_id(spark.createDataFrame(rows, table.schema)).collect()
    want = dict(zip([r[0] for r in rows], brute.languages(taught, [r[1] for r in rows], rarest), strict=True))
    assert len(got) == len(rows)
    for r in got:
        best, score, margin = want[r.doc_id]
        assert r.score == pytest.approx(score, abs=0.01)
        assert r.lang_pred == best or margin < 0.01


def test_identified_keeps_texts_where_no_language_was_learned(spark):
    rows = [*ODD, (600, "12 34 !?"), (601, "½ _ ²"), (602, "日本"), (603, "der die und")]
    untaught = docs(spark, rows).select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    kept = language_id.identified(untaught)
    assert kept.columns == ["doc_id", "text", "lang"]
    want = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr) and len(want) >= 6


def test_small_languages_are_learned_beside_large_ones(spark, monkeypatch):
    assert language_id.shares({"a": 10, "b": 1000, "c": 90}, 200) == {"a": 1.0, "b": 0.1, "c": 1.0}
    rng = np.random.default_rng(6)
    words = {k: [f"{k}{''.join(rng.choice(list(k), 5))}" for _ in range(300)] for k in ("abcd", "wxyz")}
    text = lambda k: " ".join(rng.choice(words[k], 30))
    rows = [(i, text("abcd"), "large") for i in range(600)] + [(1000 + i, text("wxyz"), "small") for i in range(4)]
    rows += [(2000, "qqq rrr qqq rrr", "one")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "RAREST", 60)
    model = language_id.learn(labelled, 60)
    assert model.langs == ["large", "one", "small"]
    assert len(model.words) <= 180 and len(model.grams) <= 180
    assert {"qqq", "rrr"} <= set(model.words) and sum(w[0] in "wxyz" for w in model.words) >= 10
    assert sum(set("wxyz") & set(g) != set() for g in model.grams) >= 10
    scorer = language_id._Scorer(model)
    got = [lang for lang, _, _ in scorer.scores([text("abcd"), text("wxyz"), "rrr", "xyzw wxxy"])]
    assert got == ["large", "small", "one", "small"]


def test_grams_of_long_runs_are_counted_whole(monkeypatch):
    rng = np.random.default_rng(5)
    runs = ["".join(map(chr, rng.integers(0x4E00, 0x4E40, n))) for n in (3, 64, 65, 2000)]
    batch = pa.RecordBatch.from_pydict({"lang": ["zh"] * 4, "word": runs, "n": [1, 2, 3, 4]})
    want = Counter()
    for run, n in zip(runs, [1, 2, 3, 4], strict=True):
        marked = f"<{run}>"
        for k in range(1, language_id.LONGEST + 1):
            for i in range(len(marked) - k + 1):
                want[marked[i : i + k]] += n
    for most in (language_id._AT_HAND, 100):
        monkeypatch.setattr(language_id, "_AT_HAND", most)
        got = Counter()
        for out in language_id._gram_counts(iter([batch])):
            assert set(out["lang"].to_pylist()) == {"zh"}
            for g, n in zip(out["word"].to_pylist(), out["n"].to_pylist(), strict=True):
                got[g] += n
        assert got == want


def test_backoff_prefers_longer_grams():
    model = language_id.Model(
        [("a", "the", 9), ("b", "der", 9)],
        [("a", "<th", 5), ("b", "<t", 90), ("b", "h", 90), ("a", "e>", 1), ("b", "e>", 1)], {"a": 9, "b": 9},
    )
    assert model.backoff("thx")[0] > model.backoff("thx")[1]
    assert not model.backoff("日").any()


def test_quality(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = docs(spark, ODD).select("doc_id", "text", F.lit("x").alias("quality"), F.lit(1.0).alias("log_words"))
    odd = odd.withColumn("doc_id", F.col("doc_id") + 10_000)
    rows = table.select("doc_id", "text", F.lit("x").alias("quality"), F.lit(1.0).alias("log_words")).unionByName(odd)
    more = spark.createDataFrame([(None, 1, 0), (3, None, 0), (999_999, 0, 0)], labels.schema)
    got = quality.quality_scores(rows, labels.unionByName(more)).collect()
    assert len(got) == table.count() + len(ODD)
    label = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    bad, good = ([s for s, q in held if q == k] for k in (0, 1))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert len({r.score for r in got if r.doc_id in (10_090, 10_091)}) == 1
    assert {r.score for r in quality.quality_scores(rows.limit(5), labels.where("false")).collect()} == {0.5}
    one = quality.quality_scores(rows.limit(50), labels.where("quality = 1")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.5
    assert quality.quality_scores(rows.where("false"), labels).count() == 0


def test_rules_are_paths():
    printed = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0E-1)
      Predict: 0.0
     Else (feature 1 > 2.0E-1)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 0 <= 0.25)
      Predict: 0.0
"""
    low, wide = ("a", "<=", 0.5), ("b", "<=", 0.2)
    assert quality.paths(printed, ["a", "b"]) == [
        (low,), (low, wide), (low, ("b", ">", 0.2)), (("a", ">", 0.5),), (("a", "<=", 0.25),),
    ]


def test_pipeline_stage_by_stage(spark, tmp_path):
    import random

    rng = random.Random(9)
    rows = near_copies(4, 16) + texts(6, 60) + [r for r in ODD if r[0] != 93] + [(93, "eins zwei"), (93, "eins zwei"), (95, "12 34")]
    item = " ".join(prose(rng, 30))
    rows += [(700, "before " * 5 + item + " after"), (701, item.upper())]
    folder = str(tmp_path / "tables")
    frame = docs(spark, rows).select("doc_id", "text", F.lit("xx").alias("lang"), F.lit("s").alias("source"),
                                     F.length("text").cast("long").alias("n_chars"))
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, folder).write.parquet(f"{folder}/{k}")
        out = spark.read.parquet(f"{folder}/{k}")
        if name == "language_id":
            assert out.dtypes == frame.dtypes
        elif name == "line_dedup":
            assert out.count() == len(kept) and out.where("n_chars <> length(text)").count() == 0
            kept = [(r.doc_id, r.text) for r in out.collect()]
        elif name == "near_duplicates":
            groups = {d: c for d, _, c in brute.jaccard_components(kept)}
            kept = list({(d, t) for d, t in kept if groups.get(d, d) == d})
        elif name == "decontamination":
            kept = [(d, t) for d, t in kept if not brute.contaminated(t, [(1, item)])]
        if name != "packing":
            assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(kept, key=repr)
            assert out.columns == frame.columns
    packed_right(kept, out.collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "ids_crc32").collect()), key=repr) == sorted(
        map(tuple, out.select("doc_id", "start", "ids_crc32").collect()), key=repr)
