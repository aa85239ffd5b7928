"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Hadamard transform. The hash of
a rotated vector is the axis it is nearest to, with its sign; several of these
make the bucket of a table. A vector lies in its own bucket of each table and
is also sent to the next best ones (multiprobe); two vectors are compared where
the own bucket of one is a bucket of the other. Equal vectors are folded first.
A pair is counted in the first bucket it shares only, so pairs are never
gathered: each bucket sends sums and one chain of links per vector. Buckets
beyond a size are cut into blocks, and all pairs of blocks compared.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .shared import connected, values, with_few, written
from .whitening import _lists

LEAST = 0.9  # cosine of a link
MISS = 0.004  # chance that a pair just at it shares no bucket
PROBES = 4  # buckets of a vector in each table
LOAD = 2048  # vectors meant for a bucket at most
BLOCK = 8192  # vectors of a bucket compared in one go
_ROUNDS = 3
_PAIRS = 1 << 20  # looked at together


def _rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rounds of signs and a Hadamard transform; the width is a power of two."""
    for s in signs:
        x = x * s
        half = 1
        while half < x.shape[1]:
            pairs = x.reshape(len(x), -1, 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(x.shape)
            half *= 2
        x = x / math.sqrt(x.shape[1])
    return x


class Hashes:
    """Buckets of unit vectors in ``tables`` tables, each of ``parts`` cross-polytopes."""

    def __init__(self, width: int, parts: int, tables: int, seed: int = 12):
        self.width = max(8, 1 << max(0, width - 1).bit_length())
        self.parts, self.tables, self.seed = parts, tables, seed
        self.dtype = np.min_scalar_type((2 * self.width) ** parts - 1)
        self.choices = list(itertools.product(range(min(PROBES, 2 * self.width)), repeat=parts))

    def of_table(self, x: np.ndarray, table: int) -> np.ndarray:
        """PROBES buckets of each vector, its own first."""
        signs = np.random.default_rng([self.seed, table]).choice([-1.0, 1.0], (self.parts, _ROUNDS, self.width))
        axes, losses = [], []
        for s in signs:
            y = _rotated(x, s)
            both = np.concatenate([y, -y], axis=1)
            near = np.argpartition(-both, PROBES - 1, axis=1)[:, :PROBES]
            reach = np.take_along_axis(both, near, 1)
            order = np.argsort(-reach, axis=1, kind="stable")
            axes.append(np.take_along_axis(near, order, 1))
            reach = np.take_along_axis(reach, order, 1)
            losses.append((reach[:, :1] - reach) ** 2)
        loss = np.stack([sum(losses[p][:, q] for p, q in enumerate(c)) for c in self.choices], axis=1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
        out = np.zeros((len(x), PROBES), np.int64)
        picked = np.array(self.choices)[best]
        for p in range(self.parts):
            out = out * (2 * self.width) + np.take_along_axis(axes[p], picked[:, :, p], 1)
        return out.astype(self.dtype)

    def of(self, x: np.ndarray) -> np.ndarray:
        """(vector, table, probe)"""
        x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        return np.stack([self.of_table(x, t) for t in range(self.tables)], axis=1)


def meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where buckets (..., probe) of two vectors hold the own bucket of the other."""
    return (a[..., :1] == b).any(axis=-1) | (b[..., :1] == a).any(axis=-1)


def tables_for(width: int, parts: int, least: float, miss: float) -> int:
    """Tables that pairs with cosine ``least`` need, from the share of 4,000 random ones that meet in a table."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 4000, max(2, width)))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    b = least * a + math.sqrt(1 - least * least) * b / np.linalg.norm(b, axis=1)[:, None]
    hashes = Hashes(a.shape[1], parts, 4, seed=77)
    share = float(meets(hashes.of(a), hashes.of(b)).mean())
    return max(2, math.ceil(math.log(miss) / math.log(max(1e-9, 1 - min(share, 1 - 1e-9)))))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares stay finite and above zero
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(width: int, dtype, with_vector: bool):
    """Task function: rows ``(vec_id, vector)`` to ``(vec_id, key[, v])``; the key is null where a row takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size, good = _lists(batch["vector"])
            x = np.zeros((len(batch), width))
            at = np.arange(width) < size[:, None]
            x[at] = flat
            x[~good] = 0
            good = x.any(axis=1) & np.asarray(batch["vec_id"].is_valid())
            rows = [r.tobytes() if g else None for r, g in zip((x + 0.0).astype(dtype), good.tolist(), strict=True)]
            keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in rows]
            columns = {"vec_id": batch["vec_id"], "key": pa.array(keys, pa.binary())}
            if with_vector:
                columns["v"] = pa.array(rows, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _hashed(hashes: Hashes, dtype, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.slice(lo, 2048)
                codes = hashes.of(_unit(values(part["v"], dtype).reshape(-1, width)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([c.tobytes() for c in codes], pa.binary())], [*part.schema.names, "codes"]
                )

    return run


def _codes(column: pa.Array, hashes: Hashes) -> np.ndarray:
    return values(column, hashes.dtype).reshape(-1, hashes.tables, PROBES)


def _loads(hashes: Hashes):
    """Task function: how many vectors lie in each bucket, folded per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                codes = _codes(batch["codes"], hashes).astype(np.int64)
                for t in range(hashes.tables):
                    bucket, n = np.unique(codes[:, t], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), t, np.int32)), pa.array(bucket), pa.array(n)], ["t", "bucket", "n"]
                    )

    return run


def _sent(hashes: Hashes):
    """Task function: each vector once for each of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                codes = _codes(part["codes"], hashes).astype(np.int64)
                each = hashes.tables * PROBES
                rows = part.take(pa.array(np.repeat(np.arange(len(part)), each)))
                t = np.tile(np.repeat(np.arange(hashes.tables, dtype=np.int32), PROBES), len(part))
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(codes.ravel()), *rows.columns], ["t", "bucket", *rows.schema.names])

    return run


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the smaller label to both ends of each link, in place."""
    a, b = label[a], label[b]
    apart = a != b
    if not apart.any():
        return
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for x, y in np.unique(np.stack([a[apart], b[apart]], 1), axis=0).tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    old = np.array(list(parent), np.int64)
    turn = np.arange(len(label))
    turn[old] = [root(x) for x in old.tolist()]
    label[:] = turn[label]


def linked(x, n, codes, t: int, bucket: int, split: int, least: float):
    """Links among vectors of a bucket that belong to it: (sum of ``n`` over linked ones, label) per vector.

    The first ``split`` vectors are compared with the others, or all with all where it is 0.
    """
    sums, label = np.zeros(len(x), np.int64), np.arange(len(x))
    own = codes[:, t, 0] == bucket
    left, right = (np.arange(split), np.arange(split, len(x))) if split else (np.arange(len(x)),) * 2
    step = max(1, _PAIRS // max(1, len(right)))
    for lo in range(0, len(left), step):
        a = left[lo : lo + step]
        near = x[a] @ x[right].T >= least
        near &= own[a][:, None] | own[right]
        if not split:
            near &= a[:, None] < right
        i, j = np.nonzero(near)
        i, j = a[i], right[j]
        if t and len(i):
            new = ~meets(codes[i, :t], codes[j, :t]).any(axis=1)
            i, j = i[new], j[new]
        if not len(i):
            continue
        # of the two own buckets in this table that both may lie in, the smaller one counts
        p, q = codes[i, t], codes[j, t]
        most = np.iinfo(codes.dtype).max
        first = np.minimum(
            np.where((p[:, :1] == q).any(axis=1), p[:, 0], most), np.where((q[:, :1] == p).any(axis=1), q[:, 0], most)
        )
        i, j = i[first == bucket], j[first == bucket]
        np.add.at(sums, i, n[j])
        np.add.at(sums, j, n[i])
        _joined(label, i, j)
    return sums, label


_GROUP = ["t", "bucket", "a", "b"]


def _compared(hashes: Hashes, dtype, width: int, least: float):
    """Task function: rows in order of their group, one group in memory at a time."""

    def group(rows: pa.Table | pa.RecordBatch) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        t, bucket, a, b = (rows[c][0].as_py() for c in _GROUP)
        part = rows["part"].to_numpy()
        split = 0
        if a != b:
            order = np.argsort(part, kind="stable")
            rows, split = rows.take(pa.array(order)), int((part == a).sum())
            if split in (0, len(part)):
                return None
        place, n = (rows[c].to_numpy() for c in ("place", "n"))
        x = _unit(values(rows["v"], dtype).reshape(-1, width))
        sums, label = linked(x, n, _codes(rows["codes"], hashes), t, bucket, split, least)
        some = sums > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(place[some]), pa.array(sums[some]), pa.array(place[label[some]])], ["place", "links", "root"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            if not len(batch):
                continue
            columns = np.stack([batch[c].to_numpy().astype(np.int64) for c in _GROUP], 1)
            cuts = np.r_[0, np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1, len(batch)]
            for lo, hi in itertools.pairwise(cuts.tolist()):
                now = tuple(columns[lo])
                if now != key:
                    if held and (out := group(held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks())):
                        yield out
                    held, key = [], now
                held.append(batch.slice(lo, hi - lo))
        if held and (out := group(held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks())):
            yield out

    return run


def near_vectors(
    vectors: DataFrame, least: float = LEAST, vec_id: str = "vec_id", vector: str = "embedding", miss: float = MISS,
    load: int = LOAD, block: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row.

    Rows are linked whose vectors have a cosine of at least ``least``; every link
    found is checked in double precision. Pairs at the threshold share no bucket
    with a chance of ``miss``, closer ones far less often; equal vectors always
    meet. ``n_links`` counts the other rows linked directly, ``component_id`` is
    the smallest vec_id reachable, the row's own included, and the rows of that
    id are kept. Vectors that are null or zero or hold null or non-finite
    components, and rows with a null vec_id, are linked with nothing; the latter have
    a null component and kept. Shorter vectors count as filled up with zeros. Rows that
    repeat, or share an id, are rows like others. Other columns are left out; an
    empty table gives an empty result.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    dtype = np.float32 if isinstance(rows.schema["vector"].dataType.elementType, FloatType) else np.float64
    width = max(1, rows.agg(F.max(F.size("vector"))).first()[0] or 0)
    keyed = rows.mapInArrow(_keyed(width, dtype, True), "vec_id long, key binary, v binary").where("key is not null")
    nodes = keyed.groupBy("key").agg(F.min("vec_id").alias("lo"), F.count("*").alias("n"), F.first("v").alias("v"))
    nodes = written(nodes.withColumn("place", F.monotonically_increasing_id()))

    parts = max(1, math.ceil(math.log(max(1, nodes.count() * PROBES / load)) / math.log(2 * Hashes(width, 1, 1).width)))
    hashes = Hashes(width, parts, tables_for(width, parts, least, miss))
    hashed = written(
        nodes.select("place", "n", "v").mapInArrow(_hashed(hashes, dtype, width), "place long, n long, v binary, codes binary")
    )
    loads = hashed.select("codes").mapInArrow(_loads(hashes), "t int, bucket long, n long").groupBy("t", "bucket").agg(F.sum("n").alias("n"))
    large = written(loads.where(F.col("n") > block).select("t", "bucket", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    sent = hashed.mapInArrow(_sent(hashes), "t int, bucket long, place long, n long, v binary, codes binary")
    sent = with_few(sent, large, ["t", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    sent = sent.withColumn("part", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int"))
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select(
        "t", "bucket", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "place", "n", "v", "codes"
    )
    grouped = sent.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    found = written(grouped.mapInArrow(_compared(hashes, dtype, width, least), "place long, links long, root long"))

    component = connected(rows.sparkSession, found.selectExpr("place as a", "root as b")).withColumnRenamed("node", "place")
    ends = nodes.select("place", "key", "lo", "n")
    labelled = written(ends.join(component, "place"))
    least_id = written(labelled.groupBy("component").agg(F.min("lo").alias("component_id")))
    labelled = with_few(labelled, least_id, "component").join(found.groupBy("place").agg(F.sum("links").alias("links")), "place")
    met = labelled.select("key", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    copies = ends.where("n > 1").join(component.select("place"), "place", "left_anti")
    met = written(met.unionByName(copies.select("key", (F.col("n") - 1).alias("n_links"), F.col("lo").alias("component_id"))))
    again = rows.mapInArrow(_keyed(width, dtype, False), "vec_id long, key binary")
    out = with_few(again, met, "key", "left", size=F.lit(24))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
