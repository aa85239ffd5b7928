"""N-gram Jaccard join: documents whose 5-word shingle sets are similar, exactly.

A metric-space join. Equal sets are folded first. Every rare shingle elects a
pivot, the smallest document that has it early in hash order; a document lies
in the regions of the pivots that its shingles elect. The bound on the overlap
of similar sets says how many early shingles two of them share, which lets
documents drop out (too few shared shingles) and drop their commonest ones, so
that a shared passage alone opens no region. Similar documents always meet in
a region. Inside a region documents are dealt to Voronoi cells around further
pivots, with those within the triangle-inequality window copied to the cells
next door, recursively; pairs that distances to pivots cannot rule out are
compared exactly. A region too large for one task is cut into blocks that meet
the pivots first; only documents that no pivot ties in visit the other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import (
    FOLDED, PACKED, blob, bucket_count, by_document, connected, distinct_rows, documents, folded, look_up, pack, places, shared_hashes, text_bytes,
    values, with_few, written,
)
from .text import Windows, Words, mix, slices
from .tokens import release, trim

SHINGLE = 5
RADIUS = 0.2 + 1e-9  # Jaccard distance of 80 per cent similarity
LEAF = 256  # members of a cell that is not split further
PIVOTS = 8
REGION = 3_000_000  # shingles in one task
_BYTES_PER_WORD = 6


# -- sets ---------------------------------------------------------------------


def _sets(text: pa.Array):
    """Row and hash of each distinct shingle, by row and hash, and set sizes."""
    words = Words(text, lower=True)
    counts, rows = words.counts, len(words.rows) - 1
    row = words.row_of()
    place = np.arange(len(words)) - words.first[:-1][row]
    start = np.flatnonzero((place + SHINGLE <= counts[row]) | (place == 0))
    size = np.minimum(counts[row[start]], SHINGLE)
    h = Windows(words.hashes()).at(start, size) + mix(size.astype(np.uint64))
    row = row[start]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[keep], h[keep]
    return row, h, np.bincount(row, minlength=rows).astype(np.int64)


_SALTS = (0x632BE59BD9B4E019, 0x9E6C63D0876A9A47)


def _key(h: np.ndarray, n: np.ndarray, salt: int = _SALTS[0]) -> np.ndarray:
    """One hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))])
    bounds = np.concatenate([[0], np.cumsum(n)])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array]]:
    for lo, hi in slices(batch["text"]):
        yield batch["doc_id"].slice(lo, hi - lo), batch["text"].slice(lo, hi - lo)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and two hashes of each document's set."""
    release()
    for batch in batches:
        for doc, text in _parts(batch):
            row, h, n = _sets(text)
            keys = [_key(h, n, salt) for salt in _SALTS]
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(n), pa.array(keys[0]), pa.array(keys[1])], ["doc_id", "n", "k1", "k2"]
            )
    trim()


# -- shared early shingles ------------------------------------------------------


def _least_overlap(n):
    return (4 * n + 4) // 5


def _extra(n):
    return np.maximum(1, n // 10)


def _needed(n):
    """Shared early shingles of a document with any similar one, at least."""
    return np.maximum(1, _least_overlap(n) // 10)


def _early(text: pa.Array):
    """Set key and hash of the first shingles of each set; two similar sets share ``_needed`` of them."""
    row, h, n = _sets(text)
    key = _key(h, n)
    bounds = np.concatenate([[0], np.cumsum(n)])
    upto = n - _least_overlap(n) + _extra(n)
    keep = np.arange(len(h)) - bounds[row] < upto[row]
    return key[row[keep]], h[keep]


def _sent(buckets: int, fold_rows: bool):
    def run(batches):
        for batch in batches:
            for _, text in _parts(batch):
                key, h = _early(text)
                if len(h) and fold_rows:
                    yield folded(buckets, h, key)
                elif len(h):
                    h, key = distinct_rows(h, key)
                    yield pack(buckets, h, key)
        trim()

    return run


def _found(row, h, other, lo, n):
    mine, key = values(row["h"], np.uint64), documents(row)
    hit, at = places(mine, h)
    return by_document(key[hit], h=mine[hit], pivot=lo[at[hit]], df=n[at[hit]])


def _regions_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pivots, docs, sizes = [], [], []
        columns = zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "h", "pivot", "df")), strict=True)
        for doc, n, h, pivot, df in columns:
            h, pivot, df = (np.frombuffer(b"".join(x), t) for x, t in ((h, np.uint64), (pivot, np.int64), (df, np.int64)))
            need = int(_needed(np.int64(n)))
            if len(h) < need:
                continue
            rare = np.lexsort((h, df))[: len(h) - (need - 1)]  # the commonest need - 1 cannot be all that is shared
            mine = np.unique(pivot[rare])
            pivots.append(mine)
            docs.append(np.full(len(mine), doc))
            sizes.append(np.full(len(mine), n))
        if pivots:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (pivots, docs, sizes)], ["region", "doc_id", "n"]
            )
    trim()


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text in _parts(batch):
            row, h, n = _sets(text)
            yield pa.RecordBatch.from_arrays([doc, blob(h, np.concatenate([[0], np.cumsum(n)]))], ["doc_id", "shingles"])
    trim()


# -- inside a region ------------------------------------------------------------


class Region:
    """Members with their sets; finds links that connect all similar members."""

    def __init__(self, ids, sets: list[np.ndarray]):
        self.ids = np.asarray(ids)
        self.sets = sets
        self.n = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]
        self.component = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def overlaps(self, i: int) -> np.ndarray:
        """Shingles that member i shares with each member."""
        lo = np.searchsorted(self.tokens, self.sets[i])
        hi = np.searchsorted(self.tokens, self.sets[i], side="right")
        count = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return np.bincount(self.owner[at], minlength=len(self.sets))

    def compare(self, i: int, among: np.ndarray) -> np.ndarray:
        """Distances of i to the members ``among``; notes new links."""
        both = self.overlaps(i)[among]
        either = self.n[i] + self.n[among] - both
        for j in among[100 * both >= 80 * either]:
            if self.component[j] != self.component[i]:
                self.component[self.component == self.component[j]] = self.component[i]
                self.links.append((int(self.ids[i]), int(self.ids[j])))
        return 1 - both / np.maximum(either, 1)

    def join(self, members: np.ndarray, others: np.ndarray | None = None) -> None:
        """Connect similar ``members``; with ``others``, each of the members with each of the others."""
        if others is None and len(members) > LEAF:
            step = max(1, len(members) // PIVOTS)
            far = np.stack([self.compare(i, members) for i in members[::step][:PIVOTS]])
            home = far.min(axis=0)
            cells = [members[(d <= home + 2 * RADIUS)] for d in far]
            if all(len(c) <= 0.7 * len(members) for c in cells):
                for cell in cells:
                    self.join(cell)
                return
        pool = members if others is None else others
        known = np.zeros((0, len(self.n)))
        for k, i in enumerate(members):
            among = pool[k + 1 :] if others is None else pool
            open_ = (self.component[among] != self.component[i]) & (
                100 * np.minimum(self.n[i], self.n[among]) >= 80 * np.maximum(self.n[i], self.n[among])
            )
            if open_.any() and len(known):
                open_ &= (np.abs(known[:, among] - known[:, [i]]) <= RADIUS).all(axis=0)
            if not open_.any():
                continue
            if len(known) < PIVOTS:  # this member becomes a pivot for the rest
                everyone = np.arange(len(self.n))
                known = np.concatenate([known, np.zeros((1, len(self.n)))])
                both = self.overlaps(i)
                known[-1] = 1 - both / np.maximum(self.n[i] + self.n[everyone] - both, 1)
            self.compare(i, among[open_])


def _members(table: pa.Table):
    column = table["shingles"].combine_chunks()
    return table["doc_id"].to_numpy(), [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _links(region: Region) -> pa.Table:
    a, b = np.array(region.links, np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _join_region(table: pa.Table) -> pa.Table:
    region = Region(*_members(table))
    region.join(np.arange(len(region.ids)))
    return _links(region)


def _join_block(table: pa.Table) -> pa.Table:
    """A block of a large region and the region's pivots; marks members that no pivot ties in."""
    ids, sets = _members(table)
    order = np.argsort(~table["is_pivot"].to_numpy(), kind="stable")
    region = Region(ids[order], [sets[i] for i in order])
    pivots = int(table["is_pivot"].to_numpy().sum())
    region.join(np.arange(len(ids)))
    tied = region.component == region.component[0]
    loose = np.flatnonzero(~tied[pivots:]) + pivots
    a, b = np.array(region.links, np.int64).reshape(-1, 2).T
    return pa.table({
        "a": pa.array(np.concatenate([a, region.ids[loose]]), pa.int64()),
        "b": pa.array(np.concatenate([b, np.full(len(loose), -1)]), pa.int64()),
        "loose": pa.array(np.r_[np.zeros(len(a), bool), np.ones(len(loose), bool)]),
        "region": pa.array(np.full(len(a) + len(loose), table["region"][0].as_py()), pa.int64()),
    })


def _join_loose(table: pa.Table) -> pa.Table:
    ids, sets = _members(table)
    loose = table["is_loose"].to_numpy()
    region = Region(ids, sets)
    region.join(np.flatnonzero(loose), np.flatnonzero(~loose))
    return _links(region)


def _large_regions(members: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """Links of regions with more than ``limit`` shingles, in blocks of at most about that many."""
    parts = F.ceil(F.col("load") * 2 / limit).cast("int")
    members = written(
        members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    )
    firsts = members.groupBy("region", "part", "parts").agg(F.min("doc_id").alias("doc_id"))
    rank = F.row_number().over(W.partitionBy("region").orderBy(F.xxhash64("doc_id"), "doc_id"))
    pivots = firsts.withColumn("_rank", rank).where(F.col("_rank") <= PIVOTS)
    pivots = pivots.select("region", "doc_id", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = members.select("region", "doc_id", "part", F.lit(False).alias("is_pivot")).unionByName(
        pivots.select("region", "doc_id", "part", F.lit(True).alias("is_pivot"))
    )
    out = written(
        rows.join(sets, "doc_id").groupBy("region", "part")
        .applyInArrow(_join_block, "a long, b long, loose boolean, region long")
    )
    loose = out.where("loose").select("region", F.col("a").alias("doc_id")).distinct()
    counts = loose.groupBy("region").agg(F.count("*").alias("n_loose"))
    side = members.join(counts, "region").withColumn(
        "loose_parts", F.least("parts", F.ceil(F.col("n_loose") / 1000).cast("int"))
    )
    visitors = loose.join(side.select("region", "doc_id", "parts", "loose_parts"), ["region", "doc_id"]).select(
        "region", "doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), "loose_parts").cast("int").alias("loose_part"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_loose"),
    )
    hosts = side.select(
        "region", "doc_id", F.explode(F.sequence(F.lit(0), F.col("loose_parts") - 1)).alias("loose_part"),
        "part", F.lit(False).alias("is_loose"),
    )
    more = visitors.unionByName(hosts).join(sets, "doc_id").groupBy("region", "part", "loose_part").applyInArrow(
        _join_loose, "a long, b long"
    )
    return out.where("not loose").select("a", "b").unionByName(more)


def jaccard_links(docs: DataFrame, sets: DataFrame, region: int = REGION) -> DataFrame:
    """Links ``(a, b)`` that connect documents with similar, different sets.

    ``docs(doc_id, text)``; ``sets(k1, n, doc_id)`` names one document of each set.
    """
    buckets = bucket_count(text_bytes(docs) / _BYTES_PER_WORD * 0.3)
    shared = shared_hashes(docs.mapInArrow(_sent(buckets, True), FOLDED))
    sent = docs.mapInArrow(_sent(buckets, False), PACKED)
    found = look_up(sent, shared, _found, "doc long, h binary, pivot binary, df binary")
    early = found.groupBy(F.col("doc").alias("k1")).agg(*[F.collect_list(c).alias(c) for c in ("h", "pivot", "df")])
    early = early.join(sets, "k1").select("doc_id", "n", "h", "pivot", "df")
    members = written(early.mapInArrow(_regions_of, "region long, doc_id long, n long").distinct())
    loads = members.groupBy("region").agg(F.sum("n").alias("load"), F.countDistinct("doc_id").alias("size"))
    members = written(members.join(loads.where("size > 1").drop("size"), "region"))
    needed = written(members.select("doc_id").distinct())
    rows = with_few(docs, needed, "doc_id").select("doc_id", "text").mapInArrow(_with_sets, "doc_id long, shingles binary")
    small = with_few(rows, members.where(F.col("load") <= region).select("region", "doc_id"), "doc_id")
    links = small.groupBy("region").applyInArrow(_join_region, "a long, b long")
    large = members.where(F.col("load") > region)
    if not large.isEmpty():
        links = links.unionByName(_large_regions(large, rows, region))
    return links


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", region: int = REGION) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of 80 per cent or more.

    Words are lower-cased A-Z only; a set holds the distinct 5-word shingles, or
    the whole sequence of a text with fewer words. Returns per input row
    ``doc_id, n_shingles, component_id`` (smallest doc_id reachable over links,
    itself included). Null and empty texts have an empty set and no links; a row
    with a null doc_id has no links and a null component. Rows that share a
    doc_id count as one document. Extra columns are left out whatever their
    names; an empty table gives an empty result. Similarity exactly at the
    threshold links.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keys = written(docs.mapInArrow(_keys, "doc_id long, n long, k1 long, k2 long"))
    named = keys.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    sets = written(named.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("_n")))
    first = sets.where("_n > 1").select("k1", "k2", "n", F.col("doc_id").alias("same_as"))
    copies = with_few(named, first, ["k1", "k2", "n"], size=F.lit(32)).where("doc_id > same_as")
    copies = written(copies.select("doc_id", "same_as").distinct())
    links = jaccard_links(docs.where("doc_id is not null"), sets.select("k1", "n", "doc_id"), region)
    several = named.groupBy("doc_id").agg(F.countDistinct("k1", "k2", "n").alias("_n")).where("_n > 1")  # rows that share an id
    links = links.unionByName(copies.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("same_as").alias("b")))
    of = connected(docs.sparkSession, written(links))
    to = copies.groupBy("doc_id").agg(F.min("same_as").alias("same_as"))
    out = with_few(keys, to, "doc_id", "left").withColumn("node", F.coalesce("same_as", "doc_id"))
    out = with_few(out, of, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
