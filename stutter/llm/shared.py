"""Hashes of text pieces that several documents hold.

Tasks send hashes packed: one row per slice of text and bucket of hashes, with
the values as little-endian blobs. A bucket is a range of hash values, so blobs
are cut from one sorted array. Before they are sent, values are folded per
slice, so a piece that a third of all documents hold counts once per slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stutter.operators.blocks import durable, scratch

from .tokens import trim

BUCKET = 500_000  # values meant for one bucket
_LEAST_BUCKETS, _MOST_BUCKETS = 256, 1 << 20
FEW_BYTES = 24 << 20  # most that is broadcast
ROWS = 2_000  # whole texts read, or handed to Python, at a time
_AT_A_TIME = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def in_small_batches(spark: SparkSession) -> None:
    """From now on this session reads rows, and hands them to Python, at most ``ROWS`` at a time.

    Spark's 4,096 and 10,000 are meant for narrow rows. Of whole texts a batch
    takes tens of megabytes, which a task holds in the reader, in Arrow's
    buffers (twice while they grow) and in its Python worker; what has been
    freed stays with the executor. Rows and results are the same.
    """
    for key in _AT_A_TIME:
        if not 0 < int(spark.conf.get(key)) <= ROWS:
            spark.conf.set(key, str(ROWS))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, deleted when the application ends; later uses read it."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def bucket_count(values: float) -> int:
    return int(min(_MOST_BUCKETS, max(_LEAST_BUCKETS, values // BUCKET)))


def values(column: pa.Array, dtype) -> np.ndarray:
    """All blobs of a column, end to end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray) or not len(column):
        return np.zeros(0, dtype)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype) if at[0] % 8 == 0 else np.frombuffer(
        data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes(), dtype
    )


def blob(array: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Pieces of an array, cut at ``bounds``, as blobs."""
    array = np.ascontiguousarray(array)
    if array.nbytes >= 1 << 31:
        raise ValueError("a column of blobs takes 2 GB or more; hand on smaller slices of text")
    offsets = (np.asarray(bounds, np.int64) * array.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(array)])


def pack(buckets: int, h: np.ndarray, doc: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with the hashes that fall in it, in order, and their columns.

    Documents are sent as distances from the smallest of the slice, in as few bytes as hold them.
    """
    order = np.argsort(h, kind="stable")
    h = h[order]
    at = ((h >> np.uint64(44)) * np.uint64(buckets) >> np.uint64(20)).astype(np.int32)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    bounds = np.r_[first, len(at)]
    base = int(doc.min()) if len(doc) else 0
    above = doc.astype(np.int64).view(np.uint64) - np.uint64(base & (1 << 64) - 1)
    width = np.min_scalar_type(int(above.max()) if len(doc) else 0).itemsize
    arrays = [
        pa.array(at[first], pa.int32()), blob(h, bounds), pa.array(np.full(len(first), base), pa.int64()),
        pa.array(np.full(len(first), width), pa.int32()), blob(above[order].astype(f"u{width}"), bounds),
    ]
    arrays += [blob(c[order], bounds) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "h", "base", "width", "doc", *columns])


PACKED = "bucket int, h binary, base long, width int, doc binary"


def documents(rows) -> np.ndarray:
    """The documents of packed rows."""
    out = [
        (np.frombuffer(d, f"u{w}").astype(np.uint64) + np.uint64(b & (1 << 64) - 1)).view(np.int64)
        for d, b, w in zip(*(rows[c].to_pylist() for c in ("doc", "base", "width")), strict=True)
    ]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def fold(h: np.ndarray, doc: np.ndarray, other: np.ndarray | None = None):
    """Each distinct (h, other) with smallest doc, largest doc and number of rows."""
    order = np.lexsort((doc, h) if other is None else (doc, other, h))
    h, doc = h[order], doc[order]
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    if other is not None:
        other = other[order]
        new[1:] |= other[1:] != other[:-1]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(h)] - 1 if len(first) else first
    return h[first], (None if other is None else other[first]), doc[first], doc[last], (last - first + 1).astype(np.int64)


def distinct_rows(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of equally long columns."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    keep = np.ones(len(order), bool)
    keep[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return [c[keep] for c in columns]


FOLDED = PACKED + ", mixed binary, n binary, other binary"
_SHARED = "bucket int, load long, h binary, other binary, lo binary, n binary"


def folded(buckets: int, h, doc, other=None) -> pa.RecordBatch:
    """What a slice sends for :func:`shared_hashes`: each hash once, with its smallest document."""
    h, other, lo, hi, n = fold(h, doc, other)
    columns = {"mixed": (lo < hi).astype(np.uint8), "n": n.astype(np.uint32)}
    if other is not None:
        return pack(buckets, h, lo, **columns, other=other)
    batch = pack(buckets, h, lo, **columns)
    return batch.append_column("other", pa.array([b""] * len(batch), pa.binary()))


def _shared_of_bucket(table: pa.Table) -> pa.Table:
    h, other = values(table["h"], np.uint64), values(table["other"], np.uint64)
    lo, mixed, n = documents(table), values(table["mixed"], np.uint8), values(table["n"], np.uint32)
    order = np.lexsort((other, h) if len(other) else (h,))
    h, lo, mixed, n = h[order], lo[order], mixed[order], n[order].astype(np.int64)
    new = np.r_[True, h[1:] != h[:-1]]
    if len(other):
        other = other[order]
        new[1:] |= other[1:] != other[:-1]
    first = np.flatnonzero(new)
    low, high = np.minimum.reduceat(lo, first), np.maximum.reduceat(lo, first)
    count = np.add.reduceat(n, first)
    keep = (low < high) | (np.maximum.reduceat(mixed, first) > 0)
    at = first[keep]
    one = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
    return pa.table({
        "bucket": table["bucket"][:1].combine_chunks(), "load": pa.array([int(n.sum())], pa.int64()),
        "h": one(h[at]), "other": one(other[at]) if len(other) else one(other), "lo": one(low[keep]),
        "n": one(count[keep]),
    })


def shared_hashes(sent: DataFrame) -> DataFrame:
    """Per bucket, the hashes of two documents or more, sorted, with smallest document and count.

    ``sent`` has rows of :func:`folded`; a bucket holds about ``BUCKET`` values.
    """
    return written(sent.groupBy("bucket").applyInArrow(_shared_of_bucket, _SHARED))


def look_up(
    sent: DataFrame, shared: DataFrame, found: Callable, schema: str, most: int | None = None
) -> DataFrame:
    """Hand each packed row of ``sent`` to ``found`` with what its bucket shares.

    Rows stream past the shared values of their bucket; no bucket is collected.
    A bucket with more than ``most`` values (four times what is meant for one),
    such as one with a hash that very many documents hold, is dealt to several tasks.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("load") / (most or 4 * BUCKET))).cast("int")
    loads = shared.select("bucket", parts.alias("parts"))
    columns = {f.name: f.dataType for f in sent.schema if f.name != "bucket"}
    left = sent.join(F.broadcast(loads), "bucket").select(  # at most _MOST_BUCKETS rows of 16 bytes
        "bucket", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"),
        *columns, *[F.lit(None).cast("binary").alias(f"s_{c}") for c in ("h", "other", "lo", "n")],
    )
    right = shared.where(F.length("h") > 0).select(
        "bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind"),
        *[F.lit(None).cast(t).alias(c) for c, t in columns.items()],
        *[F.col(c).alias(f"s_{c}") for c in ("h", "other", "lo", "n")],
    )
    both = left.unionByName(right).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = None, None
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                at = (row["bucket"][0].as_py(), row["part"][0].as_py())
                if row["kind"][0].as_py() == 0:
                    key = at
                    known = [values(row[f"s_{c}"], t) for c, t in
                             (("h", np.uint64), ("other", np.uint64), ("lo", np.int64), ("n", np.int64))]
                elif at == key:
                    out = found(row, *known)
                    if out is not None and len(out):
                        yield out
        trim()

    return both.mapInArrow(run, schema)


def places(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``h`` are in the sorted ``known``, and where."""
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    return (known[at] == h if len(known) else np.zeros(len(h), bool)), at


def pair_places(h, second, known_h, known_second) -> tuple[np.ndarray, np.ndarray]:
    """:func:`places` of pairs in pairs sorted by both; equal first halves are tried in turn."""
    if not len(known_h):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    start = np.searchsorted(known_h, h)
    found, where = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    open_ = np.arange(len(h))
    while len(open_):
        at = start[open_]
        open_, at = open_[at < len(known_h)], at[at < len(known_h)]
        same = known_h[at] == h[open_]
        open_, at = open_[same], at[same]
        hit = known_second[at] == second[open_]
        found[open_[hit]], where[open_[hit]] = True, at[hit]
        open_ = open_[~hit]
        start[open_] += 1
    return found, where


def by_document(doc: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row per document with its values as blobs."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    bounds = np.r_[first, len(doc)]
    arrays = [pa.array(doc[first], pa.int64())] + [blob(c[order], bounds) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, ["doc", *columns])


def with_few(many: DataFrame, few: DataFrame, key: str | list[str], how: str = "inner", size=None) -> DataFrame:
    """Join with a written side that has each key once or a few times.

    Up to FEW_BYTES, as counted, it is broadcast. Beyond that its keys are, if
    they fit, so that only matching rows are shuffled; else both sides are.
    ``size``: column of the bytes of a row of ``few`` beside its keys.
    """
    keys = [key] if isinstance(key, str) else key
    rows, more = few.agg(F.count("*"), F.sum(F.lit(0) if size is None else size)).first()
    if 24 * rows + (more or 0) <= FEW_BYTES:
        return many.join(F.broadcast(few), keys, how)
    if how in ("inner", "left") and 24 * rows <= FEW_BYTES:
        only = F.broadcast(few.select(*keys).distinct())
        met = many.join(only, keys, "left_semi").join(few.hint("merge"), keys)
        if how == "inner":
            return met
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema if f.name not in keys]
        return met.unionByName(many.join(only, keys, "left_anti").select(*many.columns, *rest))
    return many.join(few.hint("merge"), keys, how)


def connected(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``(node, component)`` of undirected ``links(a, b)``: the smallest node reachable.

    Rounds of taking the smallest label around and then the label of the label;
    their number grows with the logarithm of the longest chain. Every round is
    a partial aggregate and joins, so a node with very many links is no group.
    """
    edges = links.where("a <> b").selectExpr("a", "b").union(links.where("a <> b").selectExpr("b", "a")).distinct()
    edges = durable(edges)
    labels = durable(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        around = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(around.withColumnRenamed("a", "node"), "node").select(
            "node", "label", F.least("label", "near").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = durable(lower.join(jump, "next").select("node", "label", F.least("next", "far").alias("next")))
        changed = step.where("next <> label").limit(1).count()
        labels = step.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")
