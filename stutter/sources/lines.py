"""Text lines to numbered sequences.

Lines keep file order: by file, split and place within the split. Numbers come
from one count per split, so the text itself is not shuffled to be numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.blocks import div, number_rows, sum_before

HEADER_MARK = ">"
_BROADCAST_SPLITS = 1_000_000  # rows of about 150 bytes
_SPLITS_PER_PARTITION = 32  # 128 MB partitions, files counted as at least 4 MB
_LINES_PER_BLOCK = 1 << 16
_BLOCKS_PER_GROUP = 1 << 12
_FEW_SPLITS = 100_000  # rows whose counts are added up in one task


def scan_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """Lines ``value`` of text files, with the split they come from."""
    reader = spark.read
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block_start"),
    )


def is_header(mode: str = "prefix", mark: str = HEADER_MARK, value: str = "value") -> Column:
    """Header test: the line begins with ``mark``, or holds it anywhere (``contains``)."""
    if mode not in ("prefix", "contains"):
        raise ValueError(f"unknown header mode {mode!r}")
    return F.col(value).startswith(mark) if mode == "prefix" else F.col(value).contains(mark)


def drop_headers(lines: DataFrame, mode: str = "prefix", mark: str = HEADER_MARK) -> DataFrame:
    return lines.where(~is_header(mode, mark))


def header_lines(lines: DataFrame, mode: str = "prefix", mark: str = HEADER_MARK) -> DataFrame:
    return lines.where(is_header(mode, mark))


def number_in_file_order(lines: DataFrame, out: str) -> DataFrame:
    """Number lines of :func:`scan_lines`, possibly filtered, from 0 in file order."""
    split = ["file_path", "file_block_start"]
    placed = lines.withColumn("_id", F.monotonically_increasing_id())
    counts = placed.groupBy(*split).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    splits = lines.rdd.getNumPartitions() * _SPLITS_PER_PARTITION
    if splits <= _FEW_SPLITS:
        before = W.orderBy(*split).rowsBetween(W.unboundedPreceding, -1)  # one row per split
        starts = counts.withColumn("_n", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    else:
        starts = sum_before(counts, split, "_n")
    starts = starts.select(*split, (F.col("_n") - F.col("_first")).alias("_shift"))
    if splits <= _BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    return placed.join(starts, split).withColumn(out, F.col("_id") + F.col("_shift")).drop(
        "_id", "_shift", *split
    )


def read_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """``(line_no, value)`` of text files in file order."""
    return number_in_file_order(scan_lines(spark, path, line_sep), "line_no").select("line_no", "value")


def _named(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        "seq_id", F.concat(F.lit("seq"), F.col("seq_id").cast("string")).alias("seq_name"),
        F.col("value").alias("seq"),
    )


def read_records(
    spark: SparkSession, path: str, header: str = "prefix", line_sep: str | None = None
) -> DataFrame:
    """One sequence per non-header line of text files, blank lines included."""
    body = drop_headers(scan_lines(spark, path, line_sep), header)
    return _named(number_in_file_order(body, "seq_id"))


def number_records(lines: DataFrame, order: list[str], header: str = "prefix") -> DataFrame:
    """One sequence per non-header row of a table, numbered in a total ``order``."""
    return _named(number_rows(drop_headers(lines, header), [], order, "seq_id"))


def name_lookup(sequences: DataFrame, names: DataFrame) -> DataFrame:
    """Give sequence i the name i; ``names`` has columns ordinal, name.

    A sequence without a name keeps its own; an ordinal with two names stops the job.
    """
    once = names.groupBy(F.col("ordinal").alias("seq_id")).agg(F.first("name").alias("_name"), F.count("*").alias("_n"))
    twice = F.raise_error(F.concat(F.lit("several names for sequence "), F.col("seq_id").cast("string")))
    name = F.when(F.col("_n") > 1, twice.cast("string")).otherwise(F.coalesce("_name", "seq_name"))
    return sequences.join(once, "seq_id", "left").select("seq_id", name.alias("seq_name"), "seq")


def _before_each(ends: DataFrame, window) -> DataFrame:
    """Add what the rows before each one in a window add up to, and the last record these leave open."""
    past = window.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_chars0", F.coalesce(F.sum("_chars").over(past), F.lit(0))).withColumn(
        "_heads0", F.coalesce(F.sum("_heads").over(past), F.lit(0))
    )
    ends = ends.withColumn("_left_open", _moved("_left_open", "_chars0"))
    return ends.withColumn("_before", F.last("_left_open", ignorenulls=True).over(past))


def _moved(record: str, by: str) -> Column:
    """An open record ``(at, name)`` that begins further on."""
    at = (F.col(f"{record}.at") + F.col(by)).alias("at")
    return F.when(F.col(record).isNotNull(), F.struct(at, F.col(f"{record}.name").alias("name")))


def _carried(ends: DataFrame, fan: int) -> DataFrame:
    """``(_block, _chars0, _heads0, _before)``: what the blocks before each one hand on, in two levels."""
    inner = _before_each(ends.withColumn("_group", div("_block", fan)), W.partitionBy("_group").orderBy("_block"))
    groups = inner.groupBy("_group").agg(
        F.sum("_chars").alias("_chars"), F.sum("_heads").alias("_heads"),
        F.max_by("_left_open", F.when(F.col("_left_open").isNotNull(), F.col("_block"))).alias("_left_open"),
    )
    outer = _before_each(groups, W.orderBy("_group")).select(
        "_group", F.col("_chars0").alias("_chars1"), F.col("_heads0").alias("_heads1"), F.col("_before").alias("_before1")
    )
    both = inner.join(F.broadcast(outer), "_group")  # a row for each 2^28 lines
    return both.select(
        "_block", (F.col("_chars0") + F.col("_chars1")).alias("_chars0"), (F.col("_heads0") + F.col("_heads1")).alias("_heads0"),
        F.coalesce(_moved("_before", "_chars1"), F.col("_before1")).alias("_before"),
    )


def stitch_pieces(
    lines: DataFrame, by: str | None = "header", header: str = "prefix", mark: str = HEADER_MARK,
    block: int = _LINES_PER_BLOCK, fan: int = _BLOCKS_PER_GROUP,
) -> DataFrame:
    """Lines ``(line_no, value)`` as pieces of the sequence they belong to.

    ``by="header"`` begins a new sequence after each header line; ``by=None``
    drops the headers and makes one sequence of everything. The place of a line
    in its sequence is a running length, taken per block of lines and carried
    from block to block, in groups of ``fan`` blocks and then over the groups, so
    one endless record is as good as many short ones. One task sees a row for
    each group of blocks, that is of 2^28 lines.
    Pieces are what ``chunk_sequences`` takes.
    """
    head = is_header(mode=header, mark=mark)
    here = W.partitionBy("_block").orderBy("line_no")
    upto = here.rowsBetween(W.unboundedPreceding, 0)
    earlier = here.rowsBetween(W.unboundedPreceding, -1)
    marked = lines.withColumn("_block", div("line_no", block)).withColumn("_head", head)
    size = F.when(F.col("_head"), F.lit(0)).otherwise(F.length("value")).cast("long")
    opens = F.col("_head") if by == "header" else F.lit(False)
    inner = (
        marked.withColumn("_at", F.coalesce(F.sum(size).over(earlier), F.lit(0)))
        .withColumn("_records", F.sum(opens.cast("long")).over(upto))
        .withColumn(
            "_open",
            F.last(F.when(opens, F.struct(F.col("_at").alias("at"), F.col("value").alias("name"))),
                   ignorenulls=True).over(upto),
        )
    )
    # one row per block: what it adds, and the record it leaves open
    ends = inner.groupBy("_block").agg(
        F.max(F.col("_at") + size).alias("_chars"), F.max("_records").alias("_heads"),
        F.max_by("_open", "line_no").alias("_left_open"),
    )
    placed = inner.join(_carried(ends, fan), "_block").where(~F.col("_head"))
    begin = F.coalesce(F.col("_open.at") + F.col("_chars0"), F.col("_before.at"), F.lit(0))
    name = F.coalesce(F.col("_open.name"), F.col("_before.name"), F.lit("seq0"))
    number = F.col("_records") + F.col("_heads0") - 1 if by == "header" else F.lit(0).cast("long")
    return placed.select(
        number.alias("seq_id"), name.alias("seq_name"),
        (F.col("_at") + F.col("_chars0") - begin).alias("piece_start"), F.col("value").alias("piece"),
    )


_MOST_SYMBOLS = 4096


def symbols_of(rows: DataFrame, column: str) -> dict[str, str]:
    """A character for each value of a column, in order of the values."""
    values = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(_MOST_SYMBOLS + 1).collect()]
    if len(values) > _MOST_SYMBOLS:
        raise ValueError(f"{column} has more than {_MOST_SYMBOLS} values")
    return {v: chr(ord("A") + i) for i, v in enumerate(sorted(values))}


def symbol_pieces(
    rows: DataFrame, key: str, order: list[str], symbol: Column, size: int = 4096,
    symbols: dict[str, str] | None = None, skip_null: bool = False,
) -> DataFrame:
    """Rows as one string per key, one symbol each, in a total ``order``; as pieces.

    ``symbols`` gives the character of each value (see :func:`symbols_of`);
    without it values are the characters. A value that is null, has no character
    or is not a single one stops the job, since leaving it out would move all
    positions behind it; ``skip_null`` leaves out rows whose value is null. A key
    with a third of all rows is sorted and numbered over many tasks, and never
    put together beyond ``size`` symbols.
    """
    if symbols is None:
        char = symbol
    else:
        known = F.create_map(*[F.lit(x) for pair in symbols.items() for x in pair]) if symbols else F.lit(None)
        char = F.element_at(known, symbol) if symbols else F.lit(None).cast("string")
    wrong = F.raise_error(F.concat(F.lit("not one symbol: "), F.coalesce(symbol.cast("string"), F.lit("null"))))
    single = F.when(F.length(char) == 1, char).otherwise(wrong.cast("string"))
    if skip_null:
        rows = rows.where(symbol.isNotNull())
    narrow = rows.select(F.col(key).cast("long").alias("seq_id"), *order, single.alias("_symbol"))
    numbered = number_rows(narrow, ["seq_id"], order, "_pos")
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_symbol"))), lambda x: x["_symbol"]), ""
    )
    return (
        numbered.groupBy("seq_id", div("_pos", size).alias("_part"))
        .agg(text.alias("piece"))
        .select(
            "seq_id", F.concat(F.lit("seq"), F.col("seq_id").cast("string")).alias("seq_name"),
            (F.col("_part") * size).alias("piece_start"), "piece",
        )
    )
