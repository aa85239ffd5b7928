"""Chunk layout: the one shape of text that every operator reads.

A chunk row is ``(seq_id, seq_name, chunk_id, chunk_start, chunk)``. The text
holds the chunk's own characters, up to ``left`` characters before them and up
to ``right`` characters after them. A sequence of any length is a set of rows
of bounded size, so no task ever needs a whole sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_SIZE = 1 << 20
CHUNK_COLUMNS = ["seq_id", "seq_name", "chunk_id", "chunk_start", "chunk"]


def as_sequences(df: DataFrame, seq_id: str, seq: str, seq_name: str | None = None) -> DataFrame:
    """Name the columns of a table of texts as the operators expect them."""
    name = F.col(seq_name) if seq_name else F.concat(F.lit("seq"), F.col(seq_id).cast("string"))
    return df.select(
        F.col(seq_id).cast("long").alias("seq_id"),
        name.alias("seq_name"),
        F.col(seq).alias("seq"),
    )


def is_pieces(df: DataFrame) -> bool:
    return "piece" in df.columns


def chunk_sequences(
    df: DataFrame,
    size: int = CHUNK_SIZE,
    halo: int = 0,
    left: int = 0,
    spread: int | None = None,
) -> DataFrame:
    """Cut sequences into chunks of ``size`` characters with context on both sides.

    ``df`` has either whole sequences ``(seq_id, seq_name, seq)`` or pieces of
    sequences ``(seq_id, seq_name, piece_start, piece)``. Whole sequences are cut
    in place, without a shuffle. ``spread`` adds a shuffle by (sequence, chunk)
    for inputs whose few sequences are long.
    """
    if size < 1 or halo < 0 or left < 0:
        raise ValueError("size must be at least 1, halo and left at least 0")
    if max(halo, left) > size:
        raise ValueError("halo and left context cannot exceed the chunk size")
    if is_pieces(df):
        chunks = _from_pieces(df, size, halo, left)
    else:
        chunks = _from_whole(df, size, halo, left)
    if spread:
        chunks = chunks.repartition(spread, "seq_id", "chunk_id")
    return chunks


def _from_whole(df: DataFrame, size: int, right: int, left: int) -> DataFrame:
    # One regular-expression pass cuts a long string in linear time; a substring
    # per chunk would walk the string from its beginning every time.
    cut = F.regexp_extract_all("seq", F.lit("(?s).{1,%d}" % min(size, 2**31 - 1)), F.lit(0))
    pieces = F.when(F.length("seq") <= size, F.array("seq")).otherwise(cut)

    def with_context(piece: Column, i: Column) -> Column:
        parts = [piece]
        if left:
            before = F.when(i > 0, F.col("_pieces")[F.greatest(i - 1, F.lit(0))]).otherwise(F.lit(""))
            parts.insert(0, F.call_function("right", before, F.lit(left)))
        if right:
            after = F.coalesce(F.get("_pieces", i + 1), F.lit(""))
            parts.append(F.substring(after, 1, right))
        return F.concat(*parts)

    with_pieces = df.where(F.col("seq").isNotNull()).select("seq_id", "seq_name", pieces.alias("_pieces"))
    shown = F.transform("_pieces", with_context) if left or right else F.col("_pieces")
    exploded = with_pieces.select("seq_id", "seq_name", F.posexplode(shown).alias("chunk_id", "chunk"))
    return exploded.select(
        "seq_id",
        "seq_name",
        F.col("chunk_id").cast("long").alias("chunk_id"),
        (F.col("chunk_id").cast("long") * size).alias("chunk_start"),
        "chunk",
    )


def _from_pieces(df: DataFrame, size: int, right: int, left: int) -> DataFrame:
    """Pieces to chunks: each piece is sent to every chunk that shows part of it."""
    n = F.length("piece")
    first = F.greatest(F.lit(0), F.call_function("div", F.col("piece_start") - right, F.lit(size)))
    last = F.call_function("div", F.col("piece_start") + n - 1 + left, F.lit(size))
    sent = df.where(n > 0).withColumn("chunk_id", F.explode(F.sequence(first, last)))
    # the part of the piece inside [chunk start - left, chunk end + right)
    low = F.greatest(F.col("piece_start"), F.col("chunk_id") * size - left)
    high = F.least(F.col("piece_start") + n, (F.col("chunk_id") + 1) * size + right)
    part = F.substring(
        F.col("piece"),
        (low - F.col("piece_start") + 1).cast("int"),
        (high - low).cast("int"),
    )
    sent = sent.select(
        "seq_id", "seq_name", "chunk_id", low.alias("_at"), part.alias("_part"),
        (low < (F.col("chunk_id") + 1) * size).alias("_core"),
        (high > F.col("chunk_id") * size).alias("_not_before"),
    ).where(F.col("_part") != "")
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_part"))), lambda x: x["_part"]), ""
    )
    return (
        sent.groupBy("seq_id", "seq_name", "chunk_id")
        .agg(
            joined.alias("chunk"),
            F.max(F.col("_core") & F.col("_not_before")).alias("_real"),
        )
        .where("_real")  # context alone makes no chunk
        .select(
            "seq_id", "seq_name", "chunk_id",
            (F.col("chunk_id") * size).alias("chunk_start"), "chunk",
        )
    )


def assemble(base: DataFrame, ranges: DataFrame, size: int, left: int, right: int) -> DataFrame:
    """Text of ``[lo - left, hi + right)`` for rows ``(seq_id, lo, hi, ...)``.

    ``base`` holds chunks of ``size`` without context. Adds ``text`` and
    ``text_start``. Meant for few ranges: only their chunks are moved.
    """
    others = [c for c in ranges.columns if c not in ("seq_id", "lo", "hi")]
    begin = F.greatest(F.col("lo") - left, F.lit(0).cast("long"))
    wanted = ranges.withColumn(
        "chunk_id",
        F.explode(
            F.sequence(
                F.call_function("div", begin, F.lit(size)),
                F.call_function("div", F.col("hi") + right - 1, F.lit(size)),
            )
        ),
    )
    parts = base.select("seq_id", "chunk_id", "chunk").join(wanted, ["seq_id", "chunk_id"])
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "chunk"))), lambda x: x["chunk"]), ""
    )
    offset = begin - F.col("_first") * size
    return (
        parts.groupBy("seq_id", "lo", "hi", *others)
        .agg(joined.alias("_all"), F.min("chunk_id").alias("_first"))
        .select(
            "seq_id", "lo", "hi", *others,
            begin.alias("text_start"),
            F.substring(
                F.col("_all"),
                (offset + 1).cast("int"),
                (F.col("hi") + right - begin).cast("int"),
            ).alias("text"),
        )
    )
