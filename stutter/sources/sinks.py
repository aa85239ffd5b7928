"""Writers for repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def format_repeats(repeats: DataFrame) -> DataFrame:
    """One line per repeat: ``(seq_id,seq_name,motif,count,start,end)``.

    Backslashes and line ends in names and motifs are written as ``\\\\``, ``\\n`` and ``\\r``.
    """
    name, motif = _one_line("seq_name"), _one_line("motif")
    return repeats.select(
        F.format_string("(%d,%s,%s,%d,%d,%d)", "seq_id", name, motif, "cnt", "start_pos", "end_pos").alias("value")
    )


def _one_line(column: str) -> Column:
    plain = F.replace(F.col(column), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(plain, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def write_text(repeats: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists"):
    """Write repeats as text lines; ``single_file`` brings the (small) result into one file."""
    lines = format_repeats(repeats)
    (lines.coalesce(1) if single_file else lines).write.mode(mode).text(path)


def write_parquet(repeats: DataFrame, path: str, mode: str = "errorifexists"):
    repeats.write.mode(mode).parquet(path)
