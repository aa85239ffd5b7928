"""Tasks hold little text at a time, and Python workers give back what a task has freed."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from stutter.llm import jaccard_join, language_id, line_chunks, shared


TO_PYTHON, READ = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


@pytest.fixture
def settings(spark):
    """The session's settings as Spark has them, and as they were afterwards."""
    before = {key: spark.conf.get(key) for key in (TO_PYTHON, READ)}
    spark.conf.set(TO_PYTHON, "10000")
    spark.conf.set(READ, "4096")
    yield spark.conf
    for key, value in before.items():
        spark.conf.set(key, value)


def test_stages_hand_few_rows_to_python(spark, settings, tmp_path):
    """At 3.4 KB a text, a batch of 10,000 rows is 34 MB, held in the reader, in Arrow's buffers and in Python."""
    docs = spark.createDataFrame([(1, "one two", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "three four")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        settings.set(TO_PYTHON, "10000")
        settings.set(READ, "4096")
        stage(spark, docs, str(tmp_path))
        sizes = spark.range(5000).coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in bs), "n long")
        assert max(r.n for r in sizes.collect()) <= 2000
        assert int(settings.get(READ)) <= 2000


def test_fewer_rows_are_left_as_asked(spark, settings):
    for asked, then in (("7", "7"), ("0", "2000"), ("-1", "2000"), ("10000", "2000")):
        settings.set(TO_PYTHON, asked)
        shared.in_small_batches(spark)
        assert settings.get(TO_PYTHON) == then


def test_small_batches_change_no_row(spark, settings, tmp_path, monkeypatch):
    """Groups and texts that come in many batches give the rows that one batch gives."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    line = lambda: " ".join(rng.choices(words, k=9))
    common = [line() for _ in range(6)]
    rows = [(k, "\n".join(rng.choices(common, k=3) + [line() for _ in range(4)]), rng.choice(["aa", "bb", None])) for k in range(60)]
    rows += [(100 + k, text + " more", lang) for k, text, lang in rows[:20]] + [(None, "x y", None), (200, None, "aa"), (201, "", None)]
    frame = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def results() -> list[list]:
        out, docs = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{shared.ROWS}-{k}"
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
            columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] if k == 4 else docs.columns
            out.append(sorted(map(tuple, docs.select(*columns).collect()), key=repr))
        return out

    whole = results()
    monkeypatch.setattr(shared, "ROWS", 3)
    assert results() == whole


def test_line_dedup_sends_texts_back_by_the_slice():
    """A batch of 3 MB comes back in pieces of a slice, in the order of its rows."""
    text = "some words in a line\n" * 5000
    batch = pa.RecordBatch.from_pydict({
        "all": list(range(30)), "text": [None if k == 4 else f"{k}\n{text}" for k in range(30)],
        "gone": pa.array([[0] if k % 7 == 0 else None for k in range(30)], pa.list_(pa.int32())),
    })
    out = list(line_chunks._kept(line_chunks._without)(iter([batch])))
    assert max(b["kept_text"].nbytes for b in out) <= line_chunks.SLICE + 1000
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["all"] for r in rows] == list(range(30))
    assert [r["kept_text"] for r in rows] == [
        None if k == 4 else text.removeprefix("some words in a line\n") if k % 7 == 0 else f"{k}\n{text}" for k in range(30)]
    assert [r["n_removed"] for r in rows] == [2 if k % 7 == 0 else 0 for k in range(30)]


def test_n_grams_are_counted_over_batches():
    """Small batches do not make more rows to shuffle."""
    batch = pa.RecordBatch.from_pydict({"lang": ["aa", "aa"], "word": ["abc", "abd"], "n": [2, 3]})
    out = list(language_id._gram_counts(iter([batch] * 5)))
    assert len(out) == 1
    assert {(r["word"], r["n"]) for r in out[0].to_pylist()} >= {("a", 25), ("ab", 25), ("abc", 10), ("bd>", 15)}


def test_tasks_hand_memory_back(monkeypatch):
    """Workers outlive a task; what is free in them counts as an executor's memory until it is handed back."""
    said = []
    for module in (jaccard_join, line_chunks):
        monkeypatch.setattr(module, "trim", lambda: said.append(1))
    text = "one two three four five six\nseven eight nine\n" * 3
    shown = pa.RecordBatch.from_pydict({
        "doc_id": [1], "text": [text], "row": [1], "known": pa.array([None], pa.list_(pa.int32())),
        "asked": pa.array([[{"line": 0, "h1": 1, "h2": 2, "is_first": True}]]), "gone": pa.array([[0]], pa.list_(pa.int32())), "all": [1],
    })
    tasks = [
        jaccard_join._keys, jaccard_join._sent(256, True), jaccard_join._sent(256, False), jaccard_join._with_sets,
        line_chunks._hashed(line_chunks._chunks), line_chunks._bytes_of(line_chunks._chunks), line_chunks._kept(line_chunks._without),
    ]
    for n, task in enumerate(tasks, 1):
        assert list(task(iter([shown])))
        assert len(said) == n
