"""Packing: first-fit decreasing in randomised groups of documents.

Documents are encoded once; a piece is a full sequence of a long document or
what is left of a document. Pieces that are left go to the first open sequence
with room, largest first, found in a tournament tree of the room in each
sequence. Groups are random and of bounded size, so each is packed on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .text import slices, texts
from .tokens import encoder, trim

LENGTH = 2048
GROUP = 8192  # documents packed together, about
END = 1  # id that ends each document
TOKENIZER = "byte_bpe_50k.json"
_PIECES = "doc_id long, doc_tokens long, crcs array<long>"
PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def _encoded(name: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(name)
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                data, at = texts(batch["text"].slice(lo, hi - lo))
                raw = data.tobytes()
                ids, n = known.encode([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
                crcs, end = [], 0
                for k in n.tolist():
                    own = np.append(ids[end : end + k], np.uint32(END)).astype("<u4")
                    crcs.append([zlib.crc32(own[i : i + length].tobytes()) for i in range(0, len(own), length)])
                    end += k
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(lo, hi - lo), pa.array(n + 1), pa.array(crcs, pa.list_(pa.int64()))],
                    ["doc_id", "doc_tokens", "crcs"],
                )
        trim()

    return run


def first_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each size, placed in the given order where there is room first.

    The tree's leaves hold the room in each sequence and its inner nodes the most
    below them, so the first sequence with room is found on one way down.
    """
    leaves = 1 << max(0, (len(sizes) - 1)).bit_length()
    tree = [length] * (2 * leaves)
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        sequence[i], offset[i] = at - leaves, length - tree[at]
        tree[at] -= size
        at //= 2
        while at:
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
            at //= 2
    return sequence, offset


def _packed(length: int):
    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["doc_id"].fill_null(-1).to_numpy(), -(table["doc_tokens"].to_numpy() % length)))
        table = table.take(pa.array(order))  # the remainders, largest first
        tokens = table["doc_tokens"].to_numpy()
        full, rest = tokens // length, tokens % length
        left = np.flatnonzero(rest)
        sequence, offset = first_fit(rest[left], length)
        used = int(sequence.max()) + 1 if len(sequence) else 0
        pieces = full + (rest > 0)
        doc = np.repeat(np.arange(len(tokens)), pieces)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        is_rest = number == full[doc]
        where, at = np.empty(len(doc), np.int64), np.zeros(len(doc), np.int64)
        where[is_rest], at[is_rest] = sequence, offset
        where[~is_rest] = used + np.arange(int((~is_rest).sum()))
        group = table["group"][0].as_py() if len(table) else 0
        return pa.table({
            "doc_id": table["doc_id"].take(pa.array(doc)), "start": pa.array(number * length),
            "length": pa.array(np.where(is_rest, rest[doc], length)),
            "ids_crc32": pa.array(table["crcs"].combine_chunks().flatten()), "doc_tokens": pa.array(tokens[doc]),
            "sequence_id": pa.array(where + (group << 32)), "offset": pa.array(at),
        })

    return run


def pack_documents(
    docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, group: int = GROUP,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pack the ids of all documents, each ended by id 1, into sequences of at most ``length``.

    Returns a row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. Null text is empty (its document is one id long), a
    null doc_id stays null and is packed like any other, equal rows are packed
    each on its own, remainders of equal size by doc_id. A document longer than
    a sequence fills whole ones and leaves one remainder. Other columns are
    left out; an empty table gives an empty result. ``sequence_id`` is unique
    over all groups but not gapless.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    encoded = written(docs.mapInArrow(_encoded(tokenizer, length), _PIECES))
    groups = max(1, round(encoded.count() / group))
    # written rows come in the same order again, and equal rows are dealt to different groups
    dealt = encoded.withColumn("group", (F.rand(17) * groups).cast("long"))
    return dealt.groupBy("group").applyInArrow(_packed(length), PACKED)
