"""Building blocks that keep every group bounded.

One key may own a third of all rows, so nothing is ordered or folded per key as
a whole. Work is done per (key, block of positions); only the rows at the block
borders, two per block, are then looked at per key.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1 << 20
_INNER = -1  # block number of the border rows in the second step


def div(a, b) -> Column:
    """Integer quotient of columns, column names or numbers."""
    a, b = (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return F.call_function("div", a, b)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a temporary one only in local mode without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="stutter-")
            _delete_on_exit(spark, folder)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def _delete_on_exit(spark: SparkSession, folder: str) -> None:
    """Make a folder that goes when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    folder = f"{shared_folder(spark)}/scratch"
    _delete_on_exit(spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def durable_counted(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """:func:`durable`, and how many rows meet a condition, counted while they are written."""
    seen = Observation()
    kept = durable(df.observe(seen, F.count_if(condition).alias("n")))
    return kept, seen.get["n"]


_FEW_BYTES = 32 << 20


def weighed(df: DataFrame) -> tuple[DataFrame, bool]:
    """:func:`durable`, and whether its rows are small enough in bytes to be sent to every task."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in kinds.items() if t == "string"]
    arrays = [64 * F.size(c) for c, t in kinds.items() if t == "array"]
    row = sum([*texts, *arrays], F.lit(16 * (len(kinds) + 1))).cast("long")
    seen = Observation()
    kept = durable(df.observe(seen, F.sum(row).alias("bytes")))
    return kept, (seen.get["bytes"] or 0) <= _FEW_BYTES


def join_few(many: DataFrame, few: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a side that is probably small, such as repeats.

    ``few`` is written once and weighed: up to a fixed number of bytes it is
    broadcast and ``many`` stays where it is, beyond that both are shuffled and
    sorted. Spark must not decide by its own guess, since both sides are often
    exploded, which it does not foresee.
    """
    few, small = weighed(few)
    return many.join(F.broadcast(few) if small else few.hint("merge"), on, how)


def previous(
    df: DataFrame, keys: list[str], pos: str, order: list[Column], values: dict[str, Column],
    block: int = BLOCK,
) -> DataFrame:
    """Add values of the previous row of the same keys (null for the first).

    ``order`` is total and begins with ``pos`` ascending. Two light shuffles: the
    first finds the neighbour inside a block, the second links block borders.
    """
    here = W.partitionBy(*keys, "_block").orderBy(*order)
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    step1 = (
        df.withColumn("_block", div(pos, block))
        .withColumn("_row", row)
        .withColumn("_inner", F.lag("_row").over(here))
        .withColumn("_first", F.lag(F.lit(True), 1, False).over(here) == F.lit(False))
        .withColumn("_last", F.lead(F.lit(True), 1, False).over(here) == F.lit(False))
    )
    border = F.when(F.col("_first") | F.col("_last"), F.lit(_INNER)).otherwise(F.col("_block"))
    across = W.partitionBy(*keys, "_border").orderBy(*order)
    step2 = step1.withColumn("_border", border).withColumn("_outer", F.lag("_row").over(across))
    found = F.when(F.col("_first"), F.col("_outer")).otherwise(F.col("_inner"))
    step3 = step2.withColumn("_found", found)
    return step3.select(*df.columns, *[F.col(f"_found.{n}").alias(n) for n in values])


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Number rows from 0 within ``keys`` in a total ``order``, hot keys included.

    A range sort spreads a hot key over many partitions. The sorted rows are
    written once, so that counting and numbering see the same partitions.
    """
    by = [*keys, *order]
    placed = (
        df.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id())
    )
    placed = durable(placed)
    counts = placed.groupBy(*keys, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if not keys:
        starts = F.broadcast(starts)  # one row per partition of the sort
    numbered = placed.join(starts, [*keys, "_part"])
    return numbered.withColumn(out, F.col("_base") + F.col("_id") - F.col("_first")).drop(
        "_id", "_part", "_first", "_base"
    )


def sum_before(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """Replace ``value`` by its sum over the rows before, in a total ``order``.

    A range sort deals the rows out; sums of its partitions, a row each, are carried over them.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = durable(placed)
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.sum(value).alias("_sum")).select(
        "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base")
    )
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn(value, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(parts), "_part").withColumn(value, F.col(value) + F.col("_base")).drop("_part", "_base")
