"""Quality classifier: a sparse ensemble of rules.

Trees are grown on statistics of texts; every path from a root is a rule, a
conjunction of bounds. A logistic regression with lasso weighs the rules and
sets most weights to zero; the rest is compiled into one column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .text import Words, slices

LABELLED = 20_000  # labelled rows learned from, about; chosen by a hash of their ids
TREES, DEPTH = 16, 3
LASSO = 0.001
THRESHOLD = 0.7

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:?'\"()-", "bang": b"!",
    "bar": b"|", "symbol": b"#$%&*@~^=+<>/\\[]{}_`", "beyond": bytes(range(128, 256)),
}
STATISTICS = [
    "log_words", "log_bytes", "word_bytes", "longest_word", *[f"share_{c}" for c in _CLASSES], "words_per_line",
    "distinct_words", "repeated_next", "commonest_word", "distinct_triples", "bare_words", "marked_words",
]


def statistics(text: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text, empty ones included."""
    words = Words(text)
    rows, n = words.rows, words.counts
    size = np.diff(rows)

    def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)

    some, any_ = np.maximum(n, 1), np.maximum(size, 1)
    length = words.ends - words.starts
    out = [np.log1p(n), np.log1p(size), per_row(length, words.first) / some]
    longest = np.zeros(len(n))
    if len(length):
        full = n > 0
        longest[full] = np.maximum.reduceat(length, words.first[:-1][full])
    out.append(np.log1p(longest))
    for members in _CLASSES.values():
        is_in = np.zeros(256, bool)
        is_in[list(members)] = True
        out.append(per_row(is_in[words.data], rows) / any_)
    out.append(np.log1p(n / (1 + per_row(words.data == 0x0A, rows))))
    h, row = words.hashes(), words.row_of()
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    out.append(np.bincount(rs[new], minlength=len(n)) / some)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    out.append(per_row(again, words.first) / some)
    first = np.flatnonzero(new)
    runs = np.diff(np.concatenate([first, [len(hs)]]))
    most = np.zeros(len(n))
    np.maximum.at(most, rs[first], runs)
    out.append(most / some)
    triple = np.zeros(len(h), np.uint64)
    if len(h) > 2:
        triple[:-2] = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)
    inside = np.arange(len(h)) + 2 < words.first[1:][row] if len(h) else np.zeros(0, bool)
    order = np.lexsort((triple[inside], row[inside]))
    ts, rs = triple[inside][order], row[inside][order]
    new = np.ones(len(ts), bool)
    new[1:] = (ts[1:] != ts[:-1]) | (rs[1:] != rs[:-1])
    out.append(np.bincount(rs[new], minlength=len(n)) / np.maximum(n - 2, 1))
    solid = np.ones(256, bool)
    solid[list(b"".join(_CLASSES[c] for c in ("stop", "bang", "bar", "symbol")))] = False
    letters = np.concatenate([[0], np.cumsum(solid[words.data])])
    bare = letters[words.ends] == letters[words.starts]
    out.append(per_row(bare, words.first) / some)
    marked = np.isin(words.data[words.ends - 1], list(_CLASSES["symbol"] + _CLASSES["bang"])) if len(length) else np.zeros(0)
    out.append(per_row(marked, words.first) / some)
    return np.stack(out, axis=1)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch["text"]):
            table = statistics(batch["text"].slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(lo, hi - lo), *[pa.array(c) for c in np.ascontiguousarray(table.T)]],
                ["doc_id", *STATISTICS],
            )


Rule = tuple[tuple[str, str, float], ...]


def paths(description: str, names: list[str]) -> list[Rule]:
    """All paths from a root in the printed trees, as bounds on named statistics, without doubles."""
    found: dict[Rule, None] = {}
    trail: list[tuple[int, tuple[str, str, float]]] = []
    for line in description.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not m:
            if line.lstrip().startswith("Tree "):
                trail = []
            continue
        indent = len(m[1])
        trail = [t for t in trail if t[0] < indent] + [(indent, (names[int(m[2])], m[3], float(m[4])))]
        bounds: dict[tuple[str, str], float] = {}
        for _, (name, sign, at) in trail:  # the tightest bound of each kind
            old = bounds.get((name, sign))
            bounds[name, sign] = at if old is None else (min if sign == "<=" else max)(old, at)
        found[tuple(sorted((n, s, at) for (n, s), at in bounds.items()))] = None
    return list(found)


def condition(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n) <= at if s == "<=" else F.col(n) > at for n, s, at in rule])


class RuleModel:
    """Weighted rules; ``score()`` is their column expression."""

    def __init__(self, base: float, weighted: list[tuple[Rule, float]]):
        self.base, self.weighted = base, weighted

    def score(self) -> Column:
        total = reduce(
            lambda a, b: a + b,
            [F.when(condition(rule), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.weighted], F.lit(self.base),
        )
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def learn(rows: DataFrame, most: int = LABELLED) -> RuleModel:
    """A model from ``rows(doc_id, quality, *STATISTICS)``: all up to ``most``, else a hashed share of about ``most``."""
    counts = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    if counts.get(0, 0) == 0 or counts.get(1, 0) == 0:
        share = (counts.get(1, 0) + 1) / (n + 2)
        return RuleModel(float(np.log(share / (1 - share))), [])
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    rows = written(rows.select(F.col("quality").cast("double").alias("quality"), *STATISTICS).coalesce(6))
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="statistics").transform(rows)
    forest = RandomForestClassifier(
        labelCol="quality", featuresCol="statistics", numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="onethird",
    ).fit(vectors)
    rules = paths(forest.toDebugString, STATISTICS)
    if not rules:
        return RuleModel(float(np.log(counts[1] / counts[0])), [])
    names = [f"r{i}" for i in range(len(rules))]
    held = rows.select("quality", *[condition(r).cast("double").alias(c) for r, c in zip(rules, names, strict=True)])
    vectors = VectorAssembler(inputCols=names, outputCol="rules").transform(held).select("quality", "rules")
    fit = LogisticRegression(
        labelCol="quality", featuresCol="rules", elasticNetParam=1.0, regParam=LASSO, maxIter=40, standardization=False,
    ).fit(vectors)
    weights = fit.coefficients.toArray()
    return RuleModel(float(fit.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w])


def _fourth(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4


def quality_scores(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = LABELLED,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from ``labels(doc_id, quality)`` of rows whose crc32 of the id modulo
    4 is not 2. Null and empty texts are scored by their statistics, which are
    zeros. Labels that are null, or have no document, teach nothing; a label
    that repeats counts each time. Without labels every score is a half, with
    one class only the smoothed share of it. A null doc_id is not held out and
    not learned from. Extra columns are left out; an empty table gives an empty
    result. Statistics see the text only.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kinds = ", ".join(f"{c} double" for c in STATISTICS)
    measured = written(rows.mapInArrow(_measured, f"doc_id long, {kinds}"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & (_fourth() != 2))
    model = learn(known.join(measured, "doc_id"), most)
    scored = measured.select(
        "doc_id", F.coalesce(_fourth() == 2, F.lit(False)).alias("held_out"), model.score().alias("score")
    )
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
