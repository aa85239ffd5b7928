"""Line dedup: runs of lines removed where an earlier place has the same bytes.

Content-defined chunks. Lines are hashed, and a rolling hash over two line
hashes ends a chunk where it is smaller than at both neighbouring places, so
borders depend on the lines around them only and find their place again after
lines are put in or taken out. No chunk has fewer than two lines, unless the
text has; equal lines in a row have equal rolling hashes, thus no border among
them. Chunks that occur more than once are compared byte by byte with the first
one; only then are they removed.

What is left is completed: a repeated run goes on beyond the borders of its
chunks, and one of a few lines may hold no chunk. Every two neighbouring lines
that no removed chunk holds are looked up in the same way, which extends hits
line by line in both directions and finds the short runs. A line lies in a run
of two lines or more that an earlier place has exactly if the pair that begins
or the one that ends with it is there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import with_few, written
from .text import SLICE, Windows, slices, texts
from .tokens import release, trim

ROLL = 2  # lines in the rolling hash
LEAST = 2  # lines of a chunk, at least
_TOGETHER = 10_000  # units sent on together
_NEWLINE = 0x0A


def chunk_bounds(lines: list[bytes]) -> list[int]:
    """First line of each chunk, and the number of lines."""
    n = len(lines)
    if n < 2 * LEAST:
        return [0, n] if n else [0]
    h = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in lines], np.uint64)
    rolled = Windows(h).at(np.arange(n - ROLL + 1), ROLL)
    least = np.flatnonzero((rolled[1:-1] < rolled[:-2]) & (rolled[1:-1] < rolled[2:])) + 1
    return [0, *(least + 1).tolist(), n]  # between the two lines


def _chunks(text: str | bytes | None) -> list[tuple[int, int, bytes]]:
    """First line, number of lines and bytes of each chunk."""
    raw = text.encode() if isinstance(text, str) else text or b""
    lines = raw.split(b"\n")
    bounds = chunk_bounds(lines)
    return [(a, b - a, b"\n".join(lines[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _pairs(text: str | bytes | None) -> Iterator[tuple[int, int, bytes]]:
    """First line, number of lines and bytes of every two neighbouring lines."""
    raw = text.encode() if isinstance(text, str) else text or b""
    lines = raw.split(b"\n")
    return ((i, 2, b"\n".join(lines[i : i + 2])) for i in range(len(lines) - 1))


def _without(raw: bytes, drop: set[int]) -> tuple[int, int, bytes]:
    """Lines removed, runs removed and what is left of a text whose pairs at ``drop`` go."""
    lines = raw.split(b"\n")
    gone = np.zeros(len(lines), bool)
    at = np.fromiter(drop, np.int64, len(drop))
    gone[at] = gone[at + 1] = True
    blank = np.fromiter((not x.strip() for x in lines), bool, len(lines))
    # white space between two removed lines of white space goes with them
    edges = np.flatnonzero(np.diff(np.r_[False, blank, False].astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if gone[a] and gone[b - 1]:
            gone[a:b] = True
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return int(gone.sum()), runs, b"\n".join([x for x, g in zip(lines, gone.tolist(), strict=True) if not g])


def _rows(batch: pa.RecordBatch, column: str = "text"):
    for lo, hi in slices(batch[column]):
        data, at = texts(batch[column].slice(lo, hi - lo))
        raw = data.tobytes()
        for i in range(hi - lo):
            yield lo + i, raw[at[i] : at[i + 1]]


def _hashed(units: Callable):
    """Two hashes of each unit of several lines, but those that begin at a line in ``known``."""

    def sent(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 2, pa.int32(), *[pa.int64()] * 2), strict=True)],
            ["doc_id", "row", "line", "h1", "h2"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ids, rows, known = (batch[c].to_pylist() for c in ("doc_id", "row", "known"))
            out = []
            for i, raw in _rows(batch):
                settled = set(known[i] or ())
                for first, n, chunk in units(raw):
                    if n >= LEAST and first not in settled and chunk.strip():
                        d = hashlib.blake2b(chunk, digest_size=16).digest()
                        out.append((ids[i], rows[i], first, int.from_bytes(d[:8], "little", signed=True),
                                    int.from_bytes(d[8:], "little", signed=True)))
                        if len(out) >= _TOGETHER:
                            yield sent(out)
                            out = []
            if out:
                yield sent(out)
        trim()

    return run


def _bytes_of(units: Callable):
    """The bytes of the units that a row is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, asked = batch["doc_id"].to_pylist(), batch["row"].to_pylist(), batch["asked"]
            out, size = [], 0

            def flush():
                columns = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
                names = ["doc_id", "row", "line", "h1", "h2", "is_first", "lines", "bytes"]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

            for i, raw in _rows(batch):
                want = {a["line"]: a for a in asked[i].as_py()}
                for first, n, chunk in units(raw):
                    if first in want:
                        a = want[first]
                        out.append((ids[i], rows[i], first, a["h1"], a["h2"], a["is_first"], n, chunk))
                        size += len(chunk)
                        if size > SLICE:
                            yield flush()
                            out, size = [], 0
            if out:
                yield flush()
        trim()

    return run


def _without_chunks(raw: bytes, drop: set[int]) -> tuple[int, int, bytes]:
    """Lines removed, chunks removed and what is left of a text whose chunks at ``drop`` go."""
    removed, n_chunks, kept = 0, 0, []
    for first, n, chunk in _chunks(raw):
        if first in drop:
            removed, n_chunks = removed + n, n_chunks + 1
        else:
            kept.append(chunk)
    return removed, n_chunks, b"\n".join(kept)


def _kept(without: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"]):  # sent back by the slice, so that neither side holds a batch twice
                part = batch.slice(lo, hi - lo)
                gone = part["gone"].to_pylist()
                out = []
                is_null = part["text"].is_null().to_pylist()
                for i, raw in _rows(part):
                    drop = set(gone[i] or ())
                    n_lines = raw.count(b"\n") + 1 if raw else 0
                    removed, n_chunks, text = without(raw, drop) if drop else (0, 0, raw)
                    out.append((n_lines, removed, n_chunks, hashlib.sha256(text).hexdigest(), None if is_null[i] else text.decode()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part["all"], *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]],
                    ["all", "n_lines", "n_removed", "n_chunks_removed", "kept_sha256", "kept_text"],
                )
        trim()

    return run


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_removed, n_chunks_removed, kept_sha256, kept_text`` for every row.

    With ``whole`` every run of two lines or more is removed that an earlier
    document holds, or an earlier place of the same one that it does not
    overlap: repeated chunks, then what is repeated around and between them;
    ``n_chunks_removed`` counts the stretches cut out. Without it, only
    repeated chunks are removed, which leaves most short runs.
    Order is by doc_id, text and line, so one of several equal rows with one
    doc_id keeps nothing less than the others. Runs of white space only stay,
    and lines of white space at the end of a run may, beyond the first. Lines end at "\\n" and keep
    their other characters; null text has no lines and stays null, empty text
    stays empty. Rows with a null doc_id come after all others. Extra columns
    are left out, whatever their names; an empty table gives an empty result.
    """
    out = _deduped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", whole)
    return out.select("all.doc_id", "n_lines", "n_removed", "n_chunks_removed", "kept_sha256", "kept_text")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all its columns, repeated runs of lines cut from ``text`` by the rule of :func:`line_dedup` with ``whole``."""
    out = _deduped(docs, doc_id, text, True)
    return out.select(*[
        (F.col("kept_text") if c == text else F.col("all")[c]).alias(c) for c in docs.columns
    ])


def _repeated(rows: DataFrame, units: Callable) -> DataFrame:
    """``(doc_id, row, line, lines)`` of the units that an earlier place has, byte by byte.

    ``rows`` have the starts ``known`` of units that need not be asked for.
    """
    keys = ["doc_id", "row"]
    hashed = rows.select(*keys, "text", "known").mapInArrow(_hashed(units), "doc_id long, row long, line int, h1 long, h2 long")
    place = F.struct("doc_id", "row", "line")
    firsts = hashed.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = written(firsts)
    found = with_few(hashed, firsts, ["h1", "h2"], size=F.lit(32))
    overlaps = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("row") == F.col("first.row")) & (
        F.col("line") > F.col("first.line")) & (F.col("line") < F.col("first.line") + LEAST)
    found = found.where(~overlaps).select(*keys, "line", "h1", "h2", (place == F.col("first")).alias("is_first")).distinct()
    asked = written(found.groupBy(*keys).agg(F.collect_list(F.struct("line", "h1", "h2", "is_first")).alias("asked")))
    text_of = with_few(rows.select(*keys, "text"), asked, keys, size=32 * F.size("asked"))
    pieces = written(text_of.select(*keys, "text", "asked").mapInArrow(
        _bytes_of(units), "doc_id long, row long, line int, h1 long, h2 long, is_first boolean, lines int, bytes binary"
    ))
    # written, so that Spark can split the copies of a very common unit among tasks
    first = written(pieces.where("is_first").groupBy("h1", "h2").agg(F.first("bytes").alias("same")))
    later = pieces.where("not is_first").join(first.hint("merge"), ["h1", "h2"]).where("bytes = same")
    return written(later.select(*keys, "line", "lines"))


def _deduped(docs: DataFrame, doc_id: str, text: str, whole: bool) -> DataFrame:
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("all"), F.col(text).alias("text"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64(text).alias("row"),
    )
    keys = ["doc_id", "row"]
    none = F.lit(None).cast("array<int>").alias("known")
    gone = _repeated(rows.select(*keys, "text", none), _chunks)
    if whole:
        # from here on by pairs of lines; those inside of removed chunks are settled
        pairs = gone.select(*keys, F.explode(F.sequence(F.col("line"), F.col("line") + F.col("lines") - 2)).alias("line"))
        known = written(pairs.groupBy(*keys).agg(F.collect_set("line").alias("known")))
        left = with_few(rows.select(*keys, "text"), known, keys, "left", 8 * F.size("known"))
        gone = pairs.unionByName(_repeated(left, _pairs).select(*keys, "line"))
    gone = written(gone.groupBy(*keys).agg(F.collect_set("line").alias("gone")))
    out = with_few(rows, gone, keys, "left", 8 * F.size("gone"))
    kind = rows.schema["all"].dataType.simpleString()
    return out.select("all", "text", "gone").mapInArrow(
        _kept(_without if whole else _without_chunks),
        f"all {kind}, n_lines long, n_removed long, n_chunks_removed long, kept_sha256 string, kept_text string",
    )
