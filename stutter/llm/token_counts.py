"""Token counts: lengths only, encoded in Arrow batches balanced by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices, texts
from .tokens import counter

LIMIT = 2048


def _counted(name: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(name)
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                data, at = texts(batch["text"].slice(lo, hi - lo))
                raw = data.tobytes()
                n = known.counts([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, without added tokens.

    A row in, a row out: null text counts as empty (0 bytes, 0 tokens), a null
    doc_id stays null, equal rows have equal counts, exactly ``limit`` tokens are
    not over it. Long texts are cut at white space, where a cut cannot change
    the tokens. Other columns are left out; an empty table gives an empty result.
    The tokenizer is a file name at ``public_tokenizers.path``, for one that drops
    white space.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_counted(tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
