"""Periodic run detection: stretches of words in which a group of words repeats back to back.

Baier grouping. The first phase of Baier's suffix sorter puts every suffix in
the group of its longest Lyndon word, without sorting suffixes; the length of
that word is all that is needed here. It is run under both orders of the words.
A run has a Lyndon root that is the longest Lyndon word at some place under one
of the two orders, so each place offers two periods; the longest common
extensions to the left and right of these give the runs.

Only words that may lie in a run long enough are grouped: two windows of equal
words less than a period apart mark them, and such marks cover every run whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Windows, Words, mix, slices

LEAST = 24  # words in a run
TIMES = 3  # periods in a run
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that begins at each place, in the order of the symbols.

    Groups are taken from the highest down. The places of a group have their
    final word; each goes to the end of the word of the nearest place before
    it that is in a lower group. A lower group is parted by how many copies its
    places took in, more copies higher.
    """
    n = len(symbols)
    _, group = np.unique(symbols, return_inverse=True)
    order = np.argsort(group, kind="stable")
    members = [part.tolist() for part in np.split(order, np.cumsum(np.bincount(group))[:-1])] if n else []
    size = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    group = group.tolist()
    done, before = bytearray(n), [-1] * n
    top = len(members) - 1
    while top >= 0:
        here = [i for i in members[top] if group[i] == top]
        members[top] = None
        for i in here:
            done[i] = 1
        takers, copies, last = [], [], -1
        for i in here:
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            if j < 0:
                continue
            if j == last:
                copies[-1] += 1
            else:
                takers.append(j)
                copies.append(1)
                last = j
        parts: dict[tuple[int, int], list[int]] = {}
        for j, c in zip(takers, copies, strict=True):
            parts.setdefault((c, group[j]), []).append(j)
        for c, old in sorted(parts, reverse=True):  # each goes right above its old group
            new, up = len(members), above[old]
            members.append(parts[c, old])
            size.append(size[old] + c * size[top])
            above.append(up)
            below.append(old)
            above[old] = new
            if up >= 0:
                below[up] = new
            for j in members[new]:
                group[j] = new
        top = below[top]
    return np.array([size[g] for g in group], np.int64)


class Extensions:
    """Longest common extensions of places, exact: ranks of windows of 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.n = len(symbols)
        ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
        width = 1
        while 2 * width <= longest and self.n >= 2 * width:
            r = ranks[-1].astype(np.int64)
            pairs = r[: self.n - 2 * width + 1] * (self.n + 1) + r[width : self.n - width + 1]
            ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
            width *= 2
        self.ranks = ranks

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that agree from places a and b > a on."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            r, step = self.ranks[level], 1 << level
            while True:  # a level is taken again only at the highest one
                at = b + out
                ok = np.flatnonzero(at + step <= self.n)
                ok = ok[r[a[ok] + out[ok]] == r[at[ok]]]
                out[ok] += step
                if level + 1 < len(self.ranks) or not len(ok):
                    break
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that agree before places a and b > a."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            r, step = self.ranks[level], 1 << level
            while True:
                at = a - out - step
                ok = np.flatnonzero(at >= 0)
                ok = ok[r[at[ok]] == r[at[ok] + b[ok] - a[ok]]]
                out[ok] += step
                if level + 1 < len(self.ranks) or not len(ok):
                    break
        return out


def runs(symbols: np.ndarray, pieces: np.ndarray, least: int = LEAST, times: int = TIMES):
    """(start, length, period) of the maximal runs inside each piece, in order; ``pieces`` are their ends.

    A run has at least ``least`` symbols and ``times`` (two or more) periods.
    """
    none = np.zeros(0, np.int64)
    if not len(symbols):
        return none, none, none
    # a smallest symbol of its own ends each piece
    codes = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    at = np.asarray(pieces, np.int64)
    high = int(codes.max()) + 1
    text = np.insert(codes + 1, at, 0)
    upside_down = np.insert(high - codes, at, 0)
    ends = np.flatnonzero(text == 0)
    apart = text.copy()
    apart[ends] = high + 1 + np.arange(len(ends))
    longest = int(np.diff(ends, prepend=-1).max()) - 1
    stop = ends[np.searchsorted(ends, np.arange(len(text)))]
    found = []
    for ordered in (text, upside_down):
        period = lyndon_lengths(ordered)
        place = np.flatnonzero(np.arange(len(text)) + period < stop)
        place = place[apart[place] == apart[place + period[place]]]
        found.append(np.stack([place, period[place]], 1))
    a, p = np.concatenate(found).T
    order = np.lexsort((a, p))
    a, p = a[order], p[order]
    new = np.ones(len(a), bool)  # the next place with the same period lies in the same run
    new[1:] = (np.diff(p) != 0) | (np.diff(a) > 1)
    a, p = a[new], p[new]
    lce = Extensions(apart, longest)
    start = a - lce.left(a, a + p)
    length = a + p + lce.right(a, a + p) - start
    keep = length >= np.maximum(least, times * p)
    start, length, p = np.unique(np.stack([start[keep], length[keep], p[keep]], 1), axis=0).T
    start = start - np.searchsorted(ends, start)
    order = np.lexsort((p, start))
    return start[order], length[order], p[order]


def _marked(words: Words, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of words that may hold runs; no run leaves its stretch.

    A run of n words and period q has n - q or more words, all in windows that
    come again q words on, so all its windows have an equal one at most q away.
    """
    width = max(1, least - least // times)
    size = words.counts
    row = words.row_of()
    place = np.arange(len(words)) - words.first[:-1][row]
    start = np.flatnonzero(place + width <= size[row])
    if not len(start):
        return start, start
    h = Windows(words.hashes()).at(start, width)
    h = mix(h + row[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")  # equal windows in order of place
    same = h[order[1:]] == h[order[:-1]]
    one, two = start[order[:-1][same]], start[order[1:][same]]
    far = two - one
    while True:
        turn = np.zeros(len(words) + 1, np.int64)
        for x in (one, two):
            np.add.at(turn, x, 1)
            np.add.at(turn, x + width, -1)
        covered = np.cumsum(turn[:-1]) > 0
        edges = np.diff(np.r_[0, covered, 0].astype(np.int8))
        inner = words.first[1:-1]  # neighbours in two texts are two stretches
        inner = inner[(inner > 0) & (inner < len(words))]
        inner = inner[covered[inner - 1] & covered[inner]]
        lo, hi = np.union1d(np.flatnonzero(edges > 0), inner), np.union1d(np.flatnonzero(edges < 0), inner)
        if not len(lo):
            return lo, hi
        span = (hi - lo)[np.searchsorted(lo, one, side="right") - 1]
        close = (far * times <= span) & (two < hi[np.searchsorted(lo, one, side="right") - 1])
        if close.all():
            long = hi - lo >= least
            return lo[long], hi[long]
        one, two, far = one[close], two[close], far[close]


def find_runs(words: Words, least: int = LEAST, times: int = TIMES):
    """(start, length, period) of runs of consecutive words of each text; starts count over all words."""
    lo, hi = _marked(words, least, times)
    if not len(lo):
        return lo, lo, lo
    size = hi - lo
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)
    known: dict[bytes, int] = {}
    data, s, e = words.data, words.starts[at].tolist(), words.ends[at].tolist()
    raw, base = data[s[0] : e[-1]].tobytes(), s[0]
    symbols = np.array([known.setdefault(raw[a - base : b - base], len(known)) for a, b in zip(s, e, strict=True)], np.int64)
    start, length, period = runs(symbols, ends, least, times)
    return at[start], length, period


def _collapsed(least: int, times: int, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                column = part["text"]
                words = Words(column)
                start, length, period = find_runs(words, least, times)
                row = np.searchsorted(words.first, start, side="right") - 1
                bounds = np.searchsorted(row, np.arange(len(part) + 1))
                first = words.first[:-1][row]
                parts = pa.StructArray.from_arrays(
                    [pa.array(start - first), pa.array(length), pa.array(period)], ["start", "length", "period"]
                )
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, start + length, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = []
                for i, value in enumerate(column):
                    of_text = (value.as_py() or "").encode().split()  # at exactly the six bytes of white space
                    if bounds[i] < bounds[i + 1]:
                        drop = gone[words.first[i] : words.first[i + 1]].tolist()
                        of_text = [w for w, g in zip(of_text, drop, strict=True) if not g]
                    kept.append(b" ".join(of_text))
                yield pa.RecordBatch.from_arrays([
                    *[part[c] for c in extra], pa.array(words.counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts).cast(_RUNS),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ], [*extra, "n_words", "runs", "collapsed_text"])

    return run


def periodic_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed_text`` for each row of ``docs``.

    Words are runs of bytes other than white space (0x20, 0x09-0x0D), numbered
    from 0. ``runs`` lists every maximal run ``(start, length, period)`` with the
    smallest period, at least ``least`` words and ``times`` periods, by start and
    period. ``collapsed_text`` joins by one space the words that no run holds
    after its first period. Whole texts are searched, each in one task, in
    memory in proportion to its length; no row meets another, so nothing is
    shuffled. A null or empty text has no words, no runs and an empty collapsed
    text; a null doc_id is kept as it is and equal rows give equal results.
    Other columns are left out; an empty table gives an empty result.
    """
    if times < 2 or least < times:
        raise ValueError("a run has at least two periods, and at least as many words as periods")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_collapsed(least, times, ["doc_id"]), f"doc_id long, n_words long, runs {RUNS}, collapsed_text string")
