"""Runs and readings that go on from one range of a sequence to the next.

Helpers for one text inside a task. A run that leaves the text stands in a state
(unit it began with, gap length, gaps used, next position). What a segment does
to every state that can enter it is a small table; tables of neighbours are
composed, so a run of any length is followed without its text in one place.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np

from .scan import Rule, _Reader, to_codes

SHUT = -1  # gap class of a run that may open no more gaps


def walk(text: str, cursor: int, seed: str, gap: int, used: int, rule: Rule, cut: bool, stop_at: int):
    """Follow a run until it ends or its next position is ``stop_at`` or later.

    Returns (units, position, gap, used, ended). ``cut`` says that the text goes
    on; it then shows at least ``rule.step`` characters from ``stop_at`` on.
    """
    reader = _Reader(text, len(seed), rule, gap, used)
    units, n, k = 0, len(text), len(seed)
    while cursor < stop_at if cut else cursor + k <= n:
        jump = 0 if reader._fits(seed, cursor) else reader._jump_right(seed, cursor, n)
        if jump is None:
            return units, cursor, reader.gap, reader.used, True
        cursor += jump + k
        units += 1
    return units, cursor, reader.gap, reader.used, not cut


@dataclass
class Passage:
    """What a segment does to a run of one unit: arrays over (gap class, entry position).

    ``at`` is the next position, from the segment's end if the run goes on, else
    from its start; ``gap`` the class then; ``units`` and ``used`` are added.
    """

    at: np.ndarray
    gap: np.ndarray
    units: np.ndarray
    used: np.ndarray
    ended: np.ndarray

    def packed(self) -> bytes:
        return np.stack([self.at, self.gap, self.units, self.used, self.ended]).astype(np.int64).tobytes()

    @staticmethod
    def unpacked(data: bytes, step: int, rule: Rule) -> Passage:
        at, gap, units, used, ended = np.frombuffer(data, np.int64).reshape(5, rule.max_gap + 2, step)
        return Passage(at, gap, units, used, ended.astype(bool))


def passage(text: str, seed: str, rule: Rule, size: int, step: int, cut: bool) -> Passage:
    """Where runs of ``seed`` leave a segment of ``size`` characters, for each of ``step`` entry positions.

    Every position points to that of its next unit; pointers are doubled until
    all of them end.
    """
    k, n = len(seed), len(text)
    codes, word = to_codes(text), np.array([ord(c) for c in seed], np.uint32)
    width = n + k + rule.max_gap + 1
    fits = np.zeros(width, bool)
    if n >= k:
        same = np.zeros(n - k + 1, np.uint32 if k > 255 else np.uint8)
        for i in range(k):
            same += codes[i : n - k + 1 + i] == word[i]
        fits[: n - k + 1] = same >= k - rule.miss
    last = min(size, n) if cut else n  # positions from here on are not judged
    place = np.arange(width)
    judged = place < last
    classes = rule.max_gap + 2
    target = np.tile(place, (classes, 1))
    to_class = np.repeat(np.arange(classes)[:, None], width, 1)
    used = np.zeros((classes, width), np.int64)
    goes = judged & fits & (place + k <= n)
    target[:, goes] = place[goes] + k
    stuck = judged & ~goes
    for c in range(1, classes):  # class 0 is shut, class 1 has no gap yet
        for g in range(1, rule.max_gap + 1) if c == 1 else [c - 1]:
            spare = 0 if c == 1 else 1  # a later gap may not end on the last character
            free = np.flatnonzero(stuck & (target[c] == place) & (place + g + k + spare <= n))
            free = free[fits[free + g]]
            target[c, free], to_class[c, free], used[c, free] = free + g + k, g + 1, 1
    units = (target != place).astype(np.int64)
    follow = to_class * width + target
    flat, units, used = follow.ravel(), units.ravel(), used.ravel()
    while True:
        on = flat[flat]
        if (on == flat).all():
            break
        units, used, flat = units + units[flat], used + used[flat], on
    entry = (np.arange(classes)[:, None] * width + np.minimum(np.arange(step), width - 1)).ravel()
    shape = (classes, step)
    final = flat[entry]
    at, gap = (final % width).reshape(shape), (final // width).reshape(shape) - 1
    ended = ~(cut & (at >= last))
    return Passage(np.where(ended, at, at - size), gap, units[entry].reshape(shape), used[entry].reshape(shape), ended)


def composed(first: Passage, then: Passage) -> Passage:
    """One passage after the other; positions of ended runs stay with the segment they ended in."""
    at = np.where(first.ended, 0, first.at)
    c = first.gap + 1
    go = ~first.ended
    take = lambda mine, other: np.where(go, other[c, at], mine)
    return Passage(
        take(first.at, then.at), take(first.gap, then.gap), first.units + np.where(go, then.units[c, at], 0),
        first.used + np.where(go, then.used[c, at], 0), take(first.ended, then.ended),
    )


@dataclass
class Reading:
    """Repeats of one range, its states at both borders, and runs whose end it has to know."""

    rows: list[tuple[int, int, int, int]] = field(default_factory=list)  # k, start, count, end
    entered: tuple[int, int, int] | None = None  # next position, last cell reported, first free cell after that
    left: tuple[int, int, int] | None = None
    wanted: list[tuple] = field(default_factory=list)  # k, seed, gap, used, position


def read_range(text, origin, lo, hi, lanes, starts, rule: Rule, state, cut, mask, ends) -> Reading:
    """Read the starts of ``[lo, hi)`` for the lengths ``lanes``, which compete for the next start.

    ``state`` is what reading has come to before ``lo``; without it, reading
    begins with the text, and ``entered`` is then a guess that its left
    neighbour has to confirm. ``mask`` has the intervals that are covered
    beforehand, merged, ``ends`` what becomes of runs that leave the text:
    (units, end, first free cell after it). All positions are of the sequence.
    """
    out = Reading()
    stop = origin + len(text)
    judged = len(text) - rule.step if cut else len(text)
    shown = rule.policy != "position"
    cells = bytearray(len(text))
    far = stop  # first free cell from the end of the text on
    for a, b in mask if shown else ():
        a, b = max(a - origin, 0), b - origin
        if b < 0:
            continue
        if b >= len(text):
            far = max(far, b + origin + 1)
        b = min(b, len(text) - 1)
        cells[a : b + 1] = b"\x01" * (b + 1 - a)
    pos, reach, free_then = state or (origin, -1, 0)
    if reach >= origin:
        cells[: reach + 1 - origin] = b"\x01" * min(reach + 1 - origin, len(text))
        if reach >= stop:
            far = max(far, free_then)
    at = [0] * len(lanes)
    lists = [s.start.tolist() for s in starts]
    memory = [{} if rule.max_gaps >= len(text) else None for _ in lanes]
    if state is not None:
        out.entered = state
    while True:
        best, lane = None, 0
        for i, known in enumerate(lists):
            at[i] = bisect_left(known, pos - origin, at[i])
            if at[i] < len(known) and (best is None or known[at[i]] < best):
                best, lane = known[at[i]], i
        p = None if best is None else best + origin
        if out.entered is None and (p is None or p >= lo):
            out.entered = (max(pos, lo), reach if reach >= lo else -1, free_then)
        if p is None or p >= hi:
            break
        k, start, seed = lanes[lane], starts[lane], text[best : best + lanes[lane]]
        i = at[lane]
        units, cursor, gap, used, ended = _followed(
            text, int(start.cursor[i]), seed, int(start.gap[i]), int(start.used[i]), rule, cut, judged, memory[lane]
        )
        cnt, end, after = rule.min_repeat + units, cursor - 1 + origin, cursor + origin
        if not ended:
            key = (k, seed, gap, used, cursor + origin)
            if key in ends:
                more, end, after = ends[key]
                cnt += more
            else:
                if p >= lo:
                    out.wanted.append(key)
                if shown and cells.find(0, best) < 0:  # likely to be dropped
                    pos = p + 1
                    continue
                return out
        if shown:
            free = cells.find(0, best)
            free = far if free < 0 else free + origin
            if free > end:
                pos = p + 1
                continue
            a, b = best, min(end - origin, len(text) - 1)
            cells[a : b + 1] = b"\x01" * (b + 1 - a)
            if end >= stop:
                far = max(far, after)
            if end > reach:
                reach, free_then = end, after if end >= stop else 0
        if p >= lo:
            out.rows.append((k, p, cnt, end))
        pos = p + 1 if rule.every_start and shown else end - k + 1
    if not out.wanted:
        out.left = (max(pos, hi), reach if reach >= hi else -1, free_then if reach >= stop else 0)
    return out


_LONG_RUN = 4  # units that make a run worth remembering


def _followed(text, cursor, seed, gap, used, rule: Rule, cut, judged, memory):
    """:func:`walk` up to ``judged``; ``memory`` knows what follows places that earlier long runs came by."""
    if memory is None:
        return walk(text, cursor, seed, gap, used, rule, cut, judged)
    reader = _Reader(text, len(seed), rule, gap, used)
    k, n, path, units = len(seed), len(text), [], 0
    ended = not cut
    while cursor < judged if cut else cursor + k <= n:
        place = (seed, reader.gap, cursor)
        if place in memory:
            more, cursor, gap, extra, ended = memory[place]
            units += more
            reader.gap, reader.used = gap, reader.used + extra
            break
        jump = 0 if reader._fits(seed, cursor) else reader._jump_right(seed, cursor, n)
        if jump is None:
            ended = True
            break
        path.append((place, units, reader.used - (jump > 0)))
        cursor += jump + k
        units += 1
    if len(path) >= _LONG_RUN:
        for place, before, had in path:
            memory[place] = (units - before, cursor, reader.gap, reader.used - had, ended)
    return units, cursor, reader.gap, reader.used, ended
