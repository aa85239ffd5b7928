"""Frames and rows that several tests use."""

import model


def sequences(spark, texts):
    rows = [(i, f"seq{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "seq_id long, seq_name string, seq string")


def pieces(spark, texts, step=7):
    rows = [(i, f"seq{i}", j, t[j : j + step]) for i, t in enumerate(texts) for j in range(0, len(t), step)]
    return spark.createDataFrame(rows, "seq_id long, seq_name string, piece_start long, piece string")


def repeat_rows(df):
    return sorted((r.seq_id, r.k, r.motif, r.cnt, r.start_pos, r.end_pos) for r in df.collect())


def expected(texts, *args, **kwargs):
    return sorted((i, *row) for i, t in enumerate(texts) for row in model.read(t, *args, **kwargs))
