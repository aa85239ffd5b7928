"""Jobs: from sequences or files to repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.scan import Rule
from ..operators.exact import exact_repeats, shifted_repeats
from ..operators.intervals import drop_contained
from ..operators.relations import short_form, sorted_repeats
from ..operators.resolve import ranked_repeats
from ..operators.segments import split_repeats
from ..operators.tolerant import tolerant_repeats
from ..sources.chunks import CHUNK_SIZE
from ..sources.lines import read_lines, read_records, stitch_pieces
from ..sources.sinks import write_parquet, write_text


def find_repeats(
    df: DataFrame,
    k_list=(6,),
    min_repeat: int = 3,
    miss: int = 0,
    max_gap: int = 0,
    max_gaps: int = 10_000_000,
    primitive_only: bool = True,
    policy: str = "ranked",
    every_start: bool = False,
    size: int = CHUNK_SIZE,
    spread: int | None = None,
) -> DataFrame:
    """Repeats of sequences or pieces: ``(seq_id, seq_name, k, motif, cnt, start_pos, end_pos)``.

    ``policy`` says how motif lengths compete: ``ranked`` drops a repeat whose
    positions are all covered by earlier ones (list order), ``separate`` reads each
    length on its own, ``position`` takes the first length in the list at each
    position. ``miss`` and ``max_gap`` are tolerated mismatches per unit and the
    largest gap between units.
    ``spread`` partitions the chunks of ``separate`` exact reading anew, for inputs
    of few long strings; the other policies always do so for long sequences.
    """
    rule = Rule(tuple(k_list), min_repeat, miss, max_gap, max_gaps, primitive_only, policy, every_start)
    if rule.exact and policy == "ranked" and not every_start:
        return ranked_repeats(df, rule, size)
    if rule.exact and policy == "separate":
        how = shifted_repeats if every_start else exact_repeats
        return how(
            df, rule.k_list, min_repeat=min_repeat, primitive_only=primitive_only, size=size, spread=spread
        )
    return tolerant_repeats(df, rule, size)


def get_repeats(
    df: DataFrame, k_list, miss: int = 0, max_gap: int = 0, policy: str = "separate", **options
) -> DataFrame:
    """Every motif length on its own (or another policy), in the four-column form."""
    return short_form(find_repeats(df, k_list, miss=miss, max_gap=max_gap, policy=policy, **options))


def single_k_repeats(df: DataFrame, k: int, every_start: bool = False, **options) -> DataFrame:
    """One motif length in the four-column form."""
    return short_form(find_repeats(df, (k,), policy="separate", every_start=every_start, **options))


def mine_file(
    spark: SparkSession, source: str, target: str, k_list=(6,), stitch: bool = False,
    header: str = "prefix", form: str = "text", single_file: bool = False, split: int | None = None,
    contained: str = "keep", order: bool = False, **options,
) -> None:
    """Read text or FASTA files, find repeats, write them.

    Without ``stitch`` each non-header line is one sequence; with it the lines
    after a header are one sequence. ``split`` scans segments of that many
    characters beside the repeats over their borders. ``contained="drop"`` leaves
    out repeats that end within the one before. ``order`` writes in total order.
    """
    if stitch:
        sequences = stitch_pieces(read_lines(spark, source), header=header)
    else:
        sequences = read_records(spark, source, header)
    if contained not in ("keep", "drop"):
        raise ValueError(f"unknown choice {contained!r} for contained repeats")
    if split is None:
        found = find_repeats(sequences, k_list, **options)
    else:
        names = ("min_repeat", "miss", "max_gap", "max_gaps", "primitive_only", "policy", "every_start")
        rule = Rule(tuple(k_list), **{n: options.pop(n) for n in names if n in options})
        if options:
            raise TypeError(f"not for split jobs: {', '.join(options)}")
        found = split_repeats(sequences, split, rule)
    if contained == "drop":
        found = drop_contained(found)
    if order:
        found = sorted_repeats(found).drop("rank")
    if form == "parquet":
        write_parquet(found, target)
    else:
        write_text(found, target, single_file)
