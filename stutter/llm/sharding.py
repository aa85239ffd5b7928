"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each record goes to the shard that scores best for its key, ``-ln(u) / weight``
with ``u`` the hash of (key, shard) as a fraction. A shard that is added takes
records only into itself, and takes its share by weight. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stutter.operators.blocks import number_rows

SHARDS = 8


def shard_of(keys: list[Column], weights: dict[int, float]) -> Column:
    """The shard of a key: the least ``-ln(u) / weight``, ties to the smaller number."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need weights above 0")

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11).cast("double")
        return -F.ln((bits + 0.5) / float(1 << 53)) / F.lit(float(weight))

    scores = [F.struct(score(s, w).alias("score"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard_documents(
    docs: DataFrame, weights: dict[int, float] | None = None, grown: dict[int, float] | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``size`` is the text's UTF-8 bytes plus 1, ``slot`` numbers the rows of a
    shard from 0 by doc_id, size and crc, ``grown_shard`` is the shard under
    the weights ``grown`` (one shard more if not given). The key is doc_id:
    rows that share it share a shard, and rows with a null doc_id share one.
    Null text counts as empty (size 1, crc 0). Extra columns are left out; an
    empty table gives an empty result. Only ids, sizes and checksums are
    shuffled, dealt by range, so a hot shard or key spreads over many tasks.
    """
    weights = dict.fromkeys(range(SHARDS), 1.0) if weights is None else weights
    grown = weights | {max(weights) + 1: sum(weights.values()) / len(weights)} if grown is None else grown
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows = rows.withColumn("shard", shard_of([F.col("doc_id")], weights))
    numbered = number_rows(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        shard_of([F.col("doc_id")], grown).alias("grown_shard"),
    )
