"""Substring dedup: long passages that an earlier document has are removed.

Difference-cover anchors. Windows of ``PERIOD`` residues: the residues in
``COVER`` have every difference modulo ``PERIOD``, so for any two places of the
same 50 words some shift below ``PERIOD`` makes both places fall on residues in
``COVER``. Only runs of 50 - PERIOD + 1 = 20 words at such places are hashed;
equal passages of 50 words share at least one of these anchors, aligned. From
anchors that several documents hold, matches are extended: the 50-word windows
around them are hashed in full (128 bits), and the smallest document of each
window decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import (
    FOLDED, PACKED, bucket_count, by_document, distinct_rows, documents, folded, look_up, pack, pair_places, places, shared_hashes, text_bytes,
    values, with_few, written,
)
from .text import Windows, Words, slices

WINDOW = 50
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)  # every difference modulo 31 once
ANCHOR = WINDOW - PERIOD + 1
_BYTES_PER_WORD = 6


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word index, row and hash of each anchor, and all word hashes."""
    hashes = words.hashes()
    row = words.row_of()
    place = np.arange(len(words)) - words.first[:-1][row]
    size = words.counts[row]
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    at = np.flatnonzero(cover[place % PERIOD] & (place + ANCHOR <= size) & (size >= WINDOW))
    return at, row[at], Windows(hashes).at(at, ANCHOR), hashes


def _sent_anchors(buckets: int, fold_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                doc = batch["doc_id"].slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                _, row, h, _ = _anchors(Words(batch["text"].slice(lo, hi - lo)))
                if len(h):
                    if fold_rows:
                        yield folded(buckets, h, doc[row])
                    else:
                        h, d = distinct_rows(h, doc[row])
                        yield pack(buckets, h, d)

    return run


def _shared_anchors(row, h, other, lo, n):
    mine, doc = values(row["h"], np.uint64), documents(row)
    is_shared, _ = places(mine, h)
    return by_document(doc[is_shared], h=mine[is_shared])


def _candidates(text: pa.Array, anchors: list[np.ndarray]):
    """Row, start and two hashes of each 50-word window that holds a shared anchor."""
    words = Words(text)
    at, row, h, hashes = _anchors(words)
    if not len(at):
        return words, *[np.zeros(0, np.int64)] * 2, *[np.zeros(0, np.uint64)] * 2
    hit = np.zeros(len(at), bool)
    bounds = np.searchsorted(row, np.arange(len(anchors) + 1))
    for r, known in enumerate(anchors):
        span = slice(bounds[r], bounds[r + 1])
        hit[span], _ = places(h[span], np.sort(known))
    at, row = at[hit], row[hit]
    # windows from PERIOD - 1 words before the anchor, within the document
    first = np.maximum(at - (PERIOD - 1), words.first[:-1][row])
    last = np.minimum(at, words.first[1:][row] - WINDOW)
    turn = np.zeros(len(words) + 1, np.int64)
    ok = last >= first
    np.add.at(turn, first[ok], 1)
    np.add.at(turn, last[ok] + 1, -1)
    start = np.flatnonzero(np.cumsum(turn)[:-1] > 0)
    return words, words.row_of()[start], start, Windows(hashes).at(start, WINDOW), Windows(hashes, True).at(start, WINDOW)


def _blobs(column: pa.Array) -> list[np.ndarray]:
    """Rows of lists of blobs, or of blobs, as arrays of hashes."""
    out = []
    for x in column.to_pylist():
        out.append(np.frombuffer(x if isinstance(x, bytes) else b"".join(x or ()), np.uint64))
    return out


def _sent_windows(buckets: int, fold_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                doc = batch["doc_id"].slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                known = _blobs(batch["anchors"].slice(lo, hi - lo))
                _, row, _, h, second = _candidates(batch["text"].slice(lo, hi - lo), known)
                if len(h):
                    if fold_rows:
                        yield folded(buckets, h, doc[row], second)
                    else:
                        h, second, d = distinct_rows(h, second, doc[row])
                        yield pack(buckets, h, d, second=second)

    return run


def _earlier_windows(row, h, other, lo, n):
    mine, second = values(row["h"], np.uint64), values(row["second"], np.uint64)
    doc = documents(row)
    is_shared, at = pair_places(mine, second, h, other)
    gone = is_shared & (lo[at] < doc)
    return by_document(doc[gone], h=mine[gone] ^ (second[gone] << np.uint64(1)))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i in range(len(batch)):
            text = batch["text"][i].as_py() or ""
            gone, is_copy = batch["gone"][i].as_py(), batch["is_copy"][i].as_py()
            parts = text.encode().split()  # bytes split at exactly these six bytes
            kept, spans = parts, []
            if is_copy and len(parts) >= WINDOW:  # an earlier document has every window
                kept, spans = [], [{"start": 0, "end": len(parts)}]
            elif gone:
                words = Words(pa.array([text]))
                hashes = words.hashes()
                start = np.arange(max(0, len(words) - WINDOW + 1))
                h = Windows(hashes).at(start, WINDOW) ^ (Windows(hashes, True).at(start, WINDOW) << np.uint64(1))
                hit, _ = places(h, np.sort(np.frombuffer(b"".join(gone), np.uint64)))
                turn = np.zeros(len(words) + 1, np.int64)
                turn[start[hit]] += 1
                turn[start[hit] + WINDOW] -= 1
                covered = np.cumsum(turn)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
                spans = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
                kept = [w for w, c in zip(parts, covered, strict=True) if not c]
            whole = b" ".join(kept)
            out.append((len(parts), len(parts) - len(kept), hashlib.sha256(whole).hexdigest(), spans, whole.decode()))
        n, removed, digest, spans, kept = zip(*out) if out else ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays([
            batch["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string()),
        ], ["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"])


CUT = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, "
    "removed array<struct<start:long,end:long>>, kept_text string"
)


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every word that a window of 50 words covers which also starts in a smaller document.

    Equal texts are folded first: all but the earliest lose all their windows.
    Returns a row per input row: ``doc_id, n_words, n_removed, kept_sha256,
    removed`` (spans of word places) and ``kept_text`` (kept words joined by one
    space). Windows are judged on the input. Null text has no words; texts of
    fewer than 50 words stay as they are. Rows with the same doc_id do not
    remove each other's words, and equal rows give equal results. A row with a
    null doc_id neither removes words nor loses any. Other columns, whatever
    their names, are left out; an empty table gives an empty result.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    texts = known.select("doc_id", F.md5("text").alias("digest"))
    first = written(texts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = written(with_few(texts, first, "digest", size=F.lit(40)).where("doc_id > first").select("doc_id", "digest").distinct())
    known = with_few(known.withColumn("digest", F.md5("text")), copies, ["doc_id", "digest"], "left_anti", F.lit(40)).drop("digest")
    buckets = bucket_count(text_bytes(known) / _BYTES_PER_WORD * len(COVER) / PERIOD)
    shared = shared_hashes(known.mapInArrow(_sent_anchors(buckets, True), FOLDED))
    sent = known.mapInArrow(_sent_anchors(buckets, False), PACKED)
    anchors = written(_per_document(look_up(sent, shared, _shared_anchors, "doc long, h binary"), "anchors"))
    near = written(with_few(known, anchors, "doc_id", size=_blob_bytes("anchors")))
    windows = shared_hashes(near.mapInArrow(_sent_windows(buckets, True), FOLDED))
    sent = near.mapInArrow(_sent_windows(buckets, False), PACKED + ", second binary")
    gone = written(_per_document(look_up(sent, windows, _earlier_windows, "doc long, h binary"), "gone"))
    cut = with_few(docs, gone, "doc_id", "left", size=_blob_bytes("gone")).withColumn("digest", F.md5("text"))
    cut = with_few(cut, copies.withColumn("is_copy", F.lit(True)), ["doc_id", "digest"], "left", F.lit(40))
    return cut.select("doc_id", "text", "gone", "is_copy").mapInArrow(_cut, CUT)


def _per_document(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("h").alias(name))


def _blob_bytes(name: str):
    return F.aggregate(F.transform(name, lambda x: F.octet_length(x) + 16), F.lit(0), lambda a, b: a + b)
