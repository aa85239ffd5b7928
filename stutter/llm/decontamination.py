"""Benchmark decontamination by spaced seeds, in built-in functions only.

Tokens are lower-cased runs of letters and digits; in scripts without spaces
each character is one. Two fixed masks of five tokens, one of which ignores a
place between them, are hashed at every place of test items and training texts
and joined. Whatever two of 13 tokens (or one of 8) are replaced, one of the
masks still fits beside them, so every overlap with that many substitutions
gives a hit. Around hits, text and item are compared token by token. Items of
fewer than 8 tokens are hashed whole, and texts at each of the lengths that
occur among them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import FEW_BYTES, with_few, written

MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5))
WINDOW = 13  # tokens of an overlap
SUBSTITUTIONS = 2
LEAST = 8  # items with fewer tokens are matched whole, without substitutions
_NOT_A_WORD = r"[^\p{L}\p{N}]+"
# characters of scripts without spaces; their range is asked first, which is fast
_UNSPACED = r"([\x{0E00}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]])"


def tokens(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    apart = F.when(text.rlike(_UNSPACED), F.regexp_replace(text, _UNSPACED, " $1 ")).otherwise(text)
    return F.array_remove(F.split(F.lower(apart), _NOT_A_WORD), "")


def _seeds(df: DataFrame, words: str, masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """``df`` with a row for each place and mask: ``pos`` and ``seed``."""
    span = max(m[-1] for m in masks) + 1
    shifted = [F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))).alias(f"w{k}") for k in range(span)]
    rows = df.select(*df.columns, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w"))
    seeds = [
        F.when(F.col(f"w.w{m[-1]}").isNotNull(), F.xxhash64(F.lit(i), *[F.col(f"w.w{k}") for k in m]))
        for i, m in enumerate(masks)
    ]
    return rows.select(*df.columns, "pos", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _verified(words: Column, at: Column, item: Column) -> Column:
    """Places of ``item``, laid on ``words`` from ``at`` on, where an allowed overlap begins."""
    size = F.size(item)
    window = F.least(F.lit(WINDOW), size)
    allowed = F.when(size >= WINDOW, F.lit(SUBSTITUTIONS)).when(size >= LEAST, F.lit(1)).otherwise(F.lit(0))
    same = F.transform(
        item, lambda w, i: F.when((at + i >= 0) & (w == F.get(words, at + i)), F.lit(1)).otherwise(F.lit(0))
    )
    starts = F.sequence(F.lit(0), size - window)
    return F.filter(
        starts, lambda i: F.aggregate(F.slice(same, i + 1, window), F.lit(0), lambda a, x: a + x) >= window - allowed
    )


def _each_once(hits: DataFrame) -> DataFrame:
    """A row for each document, item and shift; of items matched whole the first place in a document only."""
    long = F.size("item") >= LEAST
    hits = hits.where(long | (F.col("piece") == F.col("item"))).withColumn("shift", F.when(long, F.col("at")))
    hits = hits.groupBy("_id", "_row", "item_id", "item", "shift").agg(F.min(F.struct("at", "piece")).alias("hit"))
    return hits.select("_id", "_row", "item_id", "item", "hit.at", "hit.piece")


def overlaps(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``_id, _row, item_id, start, end``: overlaps of ``docs(_id, _row, text)`` with test items, in tokens."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), tokens(F.col(item_text)).alias("item"))
    items = written(items.where(F.size("item") > 0).distinct())
    short = items.where(F.size("item") < LEAST).select(F.size("item").alias("n")).distinct().orderBy("n").collect()  # 7 rows at most
    masks = MASKS + tuple(tuple(range(r.n)) for r in short)
    parts = [_seeds(items.where(F.size("item") >= LEAST), "item")]
    for r in short:  # with the places of the mask among those of the texts
        whole = F.xxhash64(F.lit(masks.index(tuple(range(r.n)), len(MASKS))), *[F.get("item", F.lit(k)) for k in range(r.n)])
        parts.append(items.where(F.size("item") == r.n).select("*", F.lit(0).alias("pos"), whole.alias("seed")))
    item_seeds = reduce(DataFrame.unionByName, parts)
    item_seeds = written(item_seeds.select("seed", "item_id", F.col("pos").alias("item_pos"), "item"))
    size = item_seeds.agg(F.sum(F.lit(40) + F.aggregate("item", F.lit(0), lambda a, w: a + F.octet_length(w) + 16))).first()[0]
    texts = docs.select("_id", "_row", tokens(F.col("text")).alias("words"))
    at = F.col("pos") - F.col("item_pos")
    piece = F.slice("words", F.greatest(F.col("at"), F.lit(0)) + 1, F.size("item"))
    if (size or 0) <= FEW_BYTES:  # the words are at hand where a seed is found
        hits = _seeds(texts, "words", masks).join(F.broadcast(item_seeds), "seed").withColumn("at", at)
        hits = _each_once(hits.select("_id", "_row", "item_id", "item", "at", piece.alias("piece")))
    else:  # a large test set: only ids and seeds are shuffled, and texts fetched for hits
        seeds = _seeds(texts, "words", masks).select("_id", "_row", "pos", "seed")
        hits = seeds.join(item_seeds.drop("item").hint("merge"), "seed")
        hits = hits.select("_id", "_row", "item_id", at.alias("at")).distinct().join(items.hint("merge"), "item_id")
        hits = texts.distinct().join(hits.hint("merge"), ["_id", "_row"])
        hits = _each_once(hits.select("_id", "_row", "item_id", "item", "at", piece.alias("piece")))
    found = hits.withColumn("places", _verified(F.col("piece"), F.least(F.col("at"), F.lit(0)), F.col("item")))
    return found.where(F.size("places") > 0).select(
        "_id", "_row", "item_id", (F.col("at") + F.array_min("places")).cast("long").alias("start"),
        (F.col("at") + F.array_max("places") + F.least(F.lit(WINDOW), F.size("item"))).cast("long").alias("end"),
    )


def _keyed(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("_id"), F.xxhash64(doc_id, text).alias("_row")]


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, n_tokens, contaminated, item_ids, overlaps`` for every row.

    A document is contaminated if 13 tokens of it, or a whole item of 8 to 12,
    are those of a test item but for at most 2 (1) replaced in place, or if it
    holds all tokens of an item of 1 to 7 in a row, none replaced. ``overlaps``
    lists (item_id, start, end) in tokens; of an item of 1 to 7 tokens the first
    place in the document. Items and texts that are null or without a token
    match nothing. Equal rows get equal results, rows that share a doc_id or have none are judged each by its
    own text. Extra columns are left out; an empty table on either side gives no
    overlap.
    """
    rows = docs.select(*_keyed(docs, doc_id, text), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = overlaps(rows, benchmark, item_id, item_text)
    found = written(found.groupBy("_id", "_row").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
        F.sort_array(F.collect_set(F.struct("item_id", "start", "end"))).alias("overlaps"),
    ))
    size = F.lit(48) + 8 * F.size("item_ids") + 40 * F.size("overlaps")
    out = with_few(rows.withColumn("n_tokens", F.size(tokens(F.col("text"))).cast("long")), found, ["_id", "_row"], "left", size)
    return out.select("doc_id", "n_tokens", F.col("item_ids").isNotNull().alias("contaminated"), "item_ids", "overlaps")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` with all its columns, without the contaminated rows."""
    rows = docs.select(*_keyed(docs, doc_id, text), F.col(text).alias("text"))
    found = written(overlaps(rows, benchmark, item_id, item_text).select("_id", "_row").distinct())
    keys = _keyed(docs, doc_id, text)
    names = [c for c in docs.columns]
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_all"), *keys)
    kept = with_few(marked, found, ["_id", "_row"], "left_anti", F.lit(16))
    return kept.select(*[F.col("_all")[c].alias(c) for c in names])
