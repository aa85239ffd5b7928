"""Exact top-k search: columnar branch and bound.

Vectors are integers, kept dimension by dimension. For a block of candidates
and some queries, inner products are summed up a few dimensions at a time, the
heaviest dimensions first. What the rest can add is bounded by the product of
the lengths of the remaining parts; candidates that cannot reach the k-th best
score known so far are dropped and the columns of the others closed up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

K = 5
SCALE = 256
EVERY = 50  # ids divisible by this are queries
CANDIDATES, QUERIES = 4096, 512  # vectors in a block
_DIMENSIONS = 16  # added at a time
_TOGETHER = 64  # queries that share the closed-up columns
_EXACT = 2.0**53
_BLOCK = "block long, ids binary, keys binary, copies binary, width int, vectors binary"
_BEST = "query_id long, query_key long, vec_id long, score long"


def _takes_part(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite


def _block(table: pa.Table) -> pa.Table:
    """The rows of a block as one row of blobs."""
    rows = [np.asarray(v, np.float64) for v in table["vector"].to_pylist()]
    width = max(map(len, rows), default=0)
    matrix = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        matrix[i, : len(v)] = v
    one = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
    return pa.table({
        "block": table["block"][:1].combine_chunks().cast(pa.int64()), "ids": one(table["vec_id"].to_numpy()),
        "keys": one(table["key"].to_numpy()), "copies": one(table["copy"].to_numpy()),
        "width": pa.array([width], pa.int32()), "vectors": one(matrix),
    })


def whole_numbers(matrix: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles where these are exact, else 64-bit or Python's whole numbers."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * matrix)
    largest = np.abs(out).max(initial=0)
    if largest < _EXACT:
        return out
    if largest < 2.0**62:
        return out.astype(np.int64)
    return np.array([[x if abs(x) < _EXACT else int(y) * scale for x, y in zip(*r, strict=True)] for r in zip(
        out.tolist(), matrix.tolist(), strict=True)], object).reshape(matrix.shape)


def _large(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
    """:func:`best` without bounds, for scores that doubles do not hold; those beyond 64 bits become the last long."""
    width = candidates.shape[1]
    most = max((abs(int(x)) for m in (queries, candidates) for x in (m.max(initial=0), m.min(initial=0))), default=0)
    if most * most * max(width, 1) < 1 << 62:
        scores = candidates.astype(np.int64) @ queries.astype(np.int64).T
    else:
        whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
        scores = (whole(candidates) @ whole(queries).T) if width else np.zeros((len(candidates), len(queries)), np.int64)
    for i in range(len(queries)):
        score = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in scores[:, i].tolist()]
        order = [j for j in sorted(range(len(score)), key=lambda j: (-score[j], ids[j])) if not own[i, j]][:k]
        yield i, np.array(order, np.int64), [score[j] for j in order]


def _tails(matrix: np.ndarray, steps: list[slice]) -> list[np.ndarray]:
    """Length of what is left of each row after each step."""
    squares = [np.einsum("ij,ij->i", matrix[:, s], matrix[:, s]) for s in steps]
    out, left = [], np.zeros(len(matrix))
    for s in reversed(squares):
        out.append(np.sqrt(left))
        left = left + s
    return out[::-1]


def best(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
    """For each query, places and scores of its k best candidates; ``own[i, j]`` bars a pair."""
    width = candidates.shape[1]
    exact = queries.dtype == candidates.dtype == np.float64
    if not exact or np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * max(width, 1) >= _EXACT:
        yield from _large(queries, candidates, own, ids, k)
        return
    heavy = np.argsort(-np.einsum("ij,ij->j", candidates, candidates), kind="stable")
    queries, columns = queries[:, heavy], np.ascontiguousarray(candidates[:, heavy].T)
    steps = [slice(a, a + _DIMENSIONS) for a in range(0, width, _DIMENSIONS)]
    q_tail, c_tail = _tails(queries, steps), _tails(candidates[:, heavy], steps)
    for lo in range(0, len(queries), _TOGETHER):
        q, barred = queries[lo : lo + _TOGETHER], own[lo : lo + _TOGETHER]
        alive = np.arange(columns.shape[1])
        partial = np.zeros((len(q), len(alive)))
        part = columns
        reach = np.full(len(q), -np.inf)
        for n, step in enumerate(steps):
            partial += q[:, step] @ part[step]
            if n + 1 == len(steps):
                break
            if len(alive) > k:  # whole scores of the k that lead so far: the k-th best is at least their least
                lead = np.argpartition(np.where(barred[:, alive], -np.inf, partial), len(alive) - k, axis=1)[:, -k:]
                rest = slice(step.stop, None)
                whole = np.take_along_axis(partial, lead, 1) + np.einsum("id,dij->ij", q[:, rest], part[rest][:, lead])
                whole = np.where(np.take_along_axis(barred[:, alive], lead, 1), -np.inf, whole)
                reach = np.maximum(reach, whole.min(axis=1))
                bound = partial + np.outer(q_tail[n][lo : lo + _TOGETHER], c_tail[n][alive]) * (1 + 1e-9) + 0.5
                keep = (bound >= reach[:, None]).any(axis=0)
                if keep.sum() < 0.8 * len(keep):
                    alive, partial, part = alive[keep], partial[:, keep], part[:, keep]
        partial = np.where(barred[:, alive], -np.inf, partial)
        for i in range(len(q)):
            score = partial[i]
            free = np.flatnonzero(score > -np.inf)
            if len(free) > k:
                free = free[score[free] >= np.partition(score[free], len(free) - k)[len(free) - k]]
            order = free[np.lexsort((ids[alive[free]], -score[free]))][:k]
            yield lo + i, alive[order], score[order].astype(np.int64)


def _search(k: int, scale: int):
    def matrix(row, name):
        width = row[f"{name}width"][0].as_py()
        ids = np.frombuffer(row[f"{name}ids"][0].as_py(), np.int64)
        return ids, np.frombuffer(row[f"{name}vectors"][0].as_py(), np.float64).reshape(len(ids), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                row = batch.slice(r, 1)
                ids, c = matrix(row, "")
                q_ids, q = matrix(row, "q_")
                keys, c_keys = (np.frombuffer(row[x][0].as_py(), np.int64) for x in ("q_keys", "keys"))
                first = np.frombuffer(row["copies"][0].as_py(), np.int32) == 1
                own = (q_ids[:, None] == ids) & (keys[:, None] == c_keys) & first
                width = max(q.shape[1], c.shape[1])
                q, c = (whole_numbers(np.pad(x, ((0, 0), (0, width - x.shape[1]))), scale) for x in (q, c))
                out = [(q_ids[i], keys[i], ids[j], s) for i, js, ss in best(q, c, own, ids, k) for j, s in zip(js, ss, strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(x) for x in column], pa.int64()) for column in zip(*out, strict=True)],
                        ["query_id", "query_key", "vec_id", "score"],
                    )

    return run


def top_k(
    vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding",
    candidates: int = CANDIDATES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products, ties to the smaller vec_id.

    Components become floor(scale * x), whole numbers of any size; a score beyond
    64 bits counts as the largest or smallest long. Queries are the rows whose id is
    divisible by ``every``; candidates are all rows but the query's own, so another
    row with its id is one. Vectors that are null or hold null or non-finite
    components, and rows with a null id, take no part; shorter vectors are filled up
    with zeros. Equal query rows are asked once, equal candidate rows count each.
    Extra columns are left out; an empty table gives an empty result. The query set
    meets all rows in blocks of bounded size.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & _takes_part(F.col("vector")))
    # of equal rows, k and the query's own can matter
    folded = rows.groupBy("vec_id", "vector").agg(F.count("*").alias("n"))
    copy = F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k + 1)).cast("int"))).alias("copy")
    rows = written(folded.select("vec_id", "vector", F.xxhash64("vector").alias("key"), copy))
    queries = rows.where((F.col("vec_id") % every == 0) & (F.col("copy") == 1))
    n, m = rows.count(), queries.count()
    c_blocks, q_blocks = max(1, -(-n // candidates)), max(1, -(-m // QUERIES))
    dealt = lambda df, blocks: df.withColumn(
        "block", F.pmod(F.xxhash64("vec_id", "key", "copy"), F.lit(blocks)).cast("long")).groupBy("block").applyInArrow(_block, _BLOCK)
    c, q = dealt(rows, c_blocks), dealt(queries, q_blocks)
    q = q.select(*[F.col(x).alias(f"q_{x}") for x in q.columns if x != "block"],
                 F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("block"))
    q = q.withColumn("block", F.col("block").cast("long"))
    found = c.hint("merge").join(q, "block").mapInArrow(_search(k, scale), _BEST)
    rank = F.row_number().over(W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
