"""Command line: ``python -m stutter.plans.mine SOURCE TARGET --k 6,5,4,3,2``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .jobs import mine_file


def main(argv=None) -> None:
    p = argparse.ArgumentParser(description="Find tandem repeats in text files.")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--k", default="6", help="motif lengths in order of rank, by commas")
    p.add_argument("--min-repeat", type=int, default=3)
    p.add_argument("--miss", type=int, default=0)
    p.add_argument("--max-gap", type=int, default=0)
    p.add_argument("--max-gaps", type=int, default=10_000_000)
    p.add_argument("--every-start", action="store_true", help="go on one character after a report")
    p.add_argument("--size", type=int, help="characters of a chunk")
    p.add_argument("--spread", type=int, help="partitions for the chunks of long sequences")
    p.add_argument("--split", type=int, help="scan segments of so many characters beside border repeats")
    p.add_argument("--drop-contained", action="store_true")
    p.add_argument("--sorted", action="store_true", help="write in total order")
    p.add_argument("--policy", default="ranked", choices=["ranked", "separate", "position"])
    p.add_argument("--any-motif", action="store_true", help="accept motifs that are repeats themselves")
    p.add_argument("--header", default="prefix", choices=["prefix", "contains"])
    p.add_argument("--stitch", action="store_true", help="join the lines after a header")
    p.add_argument("--form", default="text", choices=["text", "parquet"])
    p.add_argument("--single-file", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("stutter").getOrCreate()
    chosen = {n: v for n, v in (("size", a.size), ("spread", a.spread)) if v is not None}
    mine_file(
        spark, a.source, a.target, [int(k) for k in a.k.split(",")], a.stitch, a.header, a.form,
        a.single_file, min_repeat=a.min_repeat, miss=a.miss, max_gap=a.max_gap, policy=a.policy,
        primitive_only=not a.any_motif, max_gaps=a.max_gaps, every_start=a.every_start, split=a.split,
        contained="drop" if a.drop_contained else "keep", order=a.sorted, **chosen,
    )


if __name__ == "__main__":
    main()
