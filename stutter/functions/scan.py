"""Array helpers that run inside Spark tasks, on one Arrow batch or one text.

Nothing here knows about Spark: the callers decide how text is partitioned and
hand over bounded pieces.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np

_NONE = np.empty(0, dtype=np.int64)
_LONG_RUN = 4  # units read that make a run worth remembering


@dataclass(frozen=True)
class Rule:
    """What counts as a repeat, and how competing repeats are settled."""

    k_list: tuple[int, ...]
    min_repeat: int = 3
    miss: int = 0
    max_gap: int = 0
    max_gaps: int = 10_000_000  # fixed value: default limit of gaps per run
    primitive_only: bool = True
    policy: str = "ranked"  # ranked | separate | position
    every_start: bool = False  # step one character after a report

    def __post_init__(self):
        if not self.k_list or min(self.k_list) < 1:
            raise ValueError("k_list needs motif lengths of at least 1")
        if self.min_repeat < 2:
            raise ValueError("min_repeat must be at least 2")
        if self.miss < 0 or self.max_gap < 0 or self.max_gaps < 0:
            raise ValueError("miss, max_gap and max_gaps cannot be negative")
        if self.policy not in ("ranked", "separate", "position"):
            raise ValueError(f"unknown policy {self.policy!r}")

    @property
    def exact(self) -> bool:
        return self.miss == 0 and (self.max_gap == 0 or self.max_gaps == 0)

    @property
    def reach(self) -> int:
        """Characters after a start that decide whether it is a repeat."""
        return self.min_repeat * (max(self.k_list) + self.max_gap) + 1

    @property
    def step(self) -> int:
        """Characters one more unit may look at."""
        return max(self.k_list) + self.max_gap + 1


def to_codes(text: str) -> np.ndarray:
    """One number per character; one byte each where the text allows it."""
    try:
        return np.frombuffer(text.encode("latin-1"), dtype=np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def is_primitive(word: str) -> bool:
    return (word + word).find(word, 1) == len(word)


def _true_windows(flags: np.ndarray, width: int) -> np.ndarray:
    """Starts of windows of ``width`` flags that are all true (by doubling)."""
    have = 1
    while have * 2 <= width and flags.size > have:
        flags = flags[:-have] & flags[have:]
        have *= 2
    rest = width - have
    if rest > 0:
        if flags.size <= rest:
            return _NONE
        flags = flags[:-rest] & flags[rest:]
    return np.flatnonzero(flags)


def same_after(codes: np.ndarray, k: int) -> np.ndarray:
    """For every position but the last k: does the character k later agree?"""
    return codes[:-k] == codes[k:] if codes.size > k else np.empty(0, dtype=bool)


def long_runs(flags: np.ndarray, at_least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true of a least length, as (first, length)."""
    windows = _true_windows(flags, at_least)
    if windows.size == 0:
        return _NONE, _NONE
    splits = np.flatnonzero(np.diff(windows) > 1)
    first = windows[np.concatenate(([0], splits + 1))]
    last = windows[np.concatenate((splits, [windows.size - 1]))]
    return first, last - first + at_least


def border_runs(flags: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: int):
    """(first, length) of runs of true that begin at ``begins`` or stop before ``ends``."""
    if begins.size == 0 and ends.size == 0:
        return
    breaks = np.concatenate(([-1], np.flatnonzero(~flags), [flags.size]))
    begins = begins[begins < flags.size]
    after = breaks[np.searchsorted(breaks, begins)] - begins
    yield from zip(begins[after > 0].tolist(), after[after > 0].tolist())
    ends = ends[ends <= flags.size]
    before = np.minimum(ends - breaks[np.searchsorted(breaks, ends) - 1] - 1, size)
    ends, before = ends[before > 0], before[before > 0]
    yield from zip((ends - before).tolist(), before.tolist())


# -- exact repeats on one whole text ---------------------------------------


def exact_ranked(n: int, regions: list[tuple[int, int, int]], taken=None) -> list[tuple[int, int, int]]:
    """Settle competing regions ``(k, start, length)`` of one text.

    Regions come in list order of k, then by start. A region keeps its first
    phase that still reaches a free cell. Returns (k, start, count). ``taken``
    is a byte per cell, set where the cell is covered beforehand.
    """
    taken = bytearray(n) if taken is None else taken
    kept = []
    for k, a, length in regions:
        span = length - length % k
        if taken.find(0, a, a + span) >= 0:
            shift = 0
        else:
            free = taken.find(0, a + span, a + length)
            if free < 0:
                continue
            shift = free - (a + span) + 1
        start = a + shift
        taken[start : start + span] = b"\x01" * span
        kept.append((k, start, span // k))
    return kept


# -- tolerant repeats on one text -------------------------------------------


def _agreement(codes: np.ndarray, p: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    total = np.zeros(p.size, dtype=np.int32)
    for i in range(k):
        total += codes[p + i] == codes[q + i]
    return total


def _agreement_at(codes: np.ndarray, distance: int, k: int) -> np.ndarray:
    """For every start, positions at which its unit agrees with the one ``distance`` later."""
    same = same_after(codes, distance).view(np.uint8)
    size = max(same.size - k + 1, 0)
    total = same[:size].astype(np.uint8 if k < 256 else np.uint32)
    for i in range(1, k):
        total += same[i : i + size]
    return total


def _primitive_starts(codes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Which starts have a unit that is not a shorter word written several times?"""
    keep = np.ones(starts.size, dtype=bool)
    for d in range(1, k):
        if k % d == 0:
            keep &= _agreement(codes, starts, starts + d, k - d) < k - d
    return keep


@dataclass
class Starts:
    """Starts with enough units, and where reading stands after the last of these."""

    start: np.ndarray
    cursor: np.ndarray
    gap: np.ndarray
    used: np.ndarray

    def pick(self, which) -> Starts:
        return Starts(self.start[which], self.cursor[which], self.gap[which], self.used[which])

    def moved(self, by: int) -> Starts:
        return Starts(self.start + by, self.cursor + by, self.gap, self.used)


def possible_starts(codes: np.ndarray, stops: np.ndarray, k: int, rule: Rule) -> Starts:
    """Starts whose first ``min_repeat`` units are there, in texts laid end to end.

    ``stops`` are the ends of the texts. All starts advance together, one unit per
    round, as an array of cursors. The first round looks at fixed distances and
    leaves few starts for the others.
    """
    enough = k - rule.miss
    gaps = rule.max_gap if rule.max_gaps else 0
    none = np.uint8(255) if gaps < 255 else np.uint32(2**32 - 1)
    chosen = np.full(codes.size, none, dtype=none.dtype)
    for g in range(gaps, -1, -1):  # the smallest gap is written last
        fits = _agreement_at(codes, k + g, k) >= enough
        chosen[: fits.size][fits] = g
    start = np.flatnonzero(chosen != none)
    if rule.primitive_only:
        start = start[_primitive_starts(codes, start, k)]
    limit = stops[np.searchsorted(stops, start, side="right")] if start.size else start
    gap = chosen[start].astype(np.int64)
    now = Starts(start, start + 2 * k + gap, gap, (gap > 0).astype(np.int64))
    inside = now.cursor <= limit
    now, limit = now.pick(inside), limit[inside]
    for _ in range(rule.min_repeat - 2):
        taken = np.full(now.start.size, -1, dtype=np.int64)  # gap before this unit

        def try_gap(idx: np.ndarray, size, spare: int = 0):
            """Take a gap of ``size`` where a unit follows it, ``spare`` characters before the end."""
            at = now.cursor[idx] + size
            ok = at + k + spare <= limit[idx]
            idx, at = idx[ok], at[ok]
            good = _agreement(codes, now.start[idx], at, k) >= enough
            taken[idx[good]] = at[good] - now.cursor[idx[good]]

        everyone = np.arange(now.start.size)
        try_gap(everyone, 0)
        if gaps:
            waiting = (taken < 0) & (now.used < rule.max_gaps) & (now.cursor + k <= limit)
            # the gap of a run is fixed by its first use; a later one may not end on the last character
            again = np.flatnonzero(waiting & (now.gap > 0))
            try_gap(again, now.gap[again], spare=1)
            for g in range(1, gaps + 1):
                try_gap(np.flatnonzero(waiting & (now.gap == 0) & (taken < 0)), g)
        alive = taken >= 0
        now, limit, taken = now.pick(alive), limit[alive], taken[alive]
        opened = taken > 0
        now = Starts(
            now.start, now.cursor + taken + k, np.where(opened, taken, now.gap), now.used + opened
        )
    return now


@dataclass
class _Reader:
    """Unit-by-unit reading of one text in one direction."""

    text: str
    k: int
    rule: Rule
    gap: int = 0
    used: int = 0

    def _fits(self, seed: str, at: int) -> bool:
        unit = self.text[at : at + self.k]
        if unit == seed:
            return True
        if self.rule.miss == 0:
            return False
        return sum(map(str.__eq__, unit, seed)) >= self.k - self.rule.miss

    def right(self, seed: str, cursor: int, known: dict | None = None) -> tuple[int, int]:
        """(units found, position after the last one).

        ``known`` remembers, for long runs, what follows a place in the text. Starts
        inside a run soon come to a place that an earlier start has been at.
        """
        n, k = len(self.text), self.k
        path = []
        more, stop = 0, cursor
        while stop + k <= n:
            place = (seed, self.gap, stop)
            if known and place in known:
                more, stop = known[place]
                break
            jump = 0 if self._fits(seed, stop) else self._jump_right(seed, stop, n)
            if jump is None:
                break
            path.append(place)
            stop += jump + k
        found = len(path) + more
        if known is not None and len(path) >= _LONG_RUN:
            known.update((place, (found - i, stop)) for i, place in enumerate(path))
        return found, stop

    def left(self, seed: str, cursor: int) -> tuple[int, int]:
        """(units found, position of the first one); ``cursor`` is a unit start."""
        k, found = self.k, 0
        while cursor - k >= 0:
            jump = 0 if self._fits(seed, cursor - k) else self._jump_left(seed, cursor - k)
            if jump is None:
                break
            cursor -= jump + k
            found += 1
        return found, cursor

    def _open(self, jump: int) -> int:
        self.gap, self.used = jump, self.used + 1
        return jump

    def _jump_right(self, seed: str, cursor: int, n: int):
        if self.used >= self.rule.max_gaps:
            return None
        if self.gap:
            at = cursor + self.gap
            ok = at + self.k < n and self._fits(seed, at)
            return self._open(self.gap) if ok else None
        for g in range(1, self.rule.max_gap + 1):
            if cursor + g + self.k > n:
                return None
            if self._fits(seed, cursor + g):
                return self._open(g)
        return None

    def _jump_left(self, seed: str, at: int):
        if self.used >= self.rule.max_gaps:
            return None
        choices = [self.gap] if self.gap else range(1, self.rule.max_gap + 1)
        for g in choices:
            if at - g >= 0 and self._fits(seed, at - g):
                return self._open(g)
        return None


def run_around(text: str, pos: int, k: int, rule: Rule):
    """(start, units, last position) of the run whose seed is at ``pos``.

    None if there can be no seed. Reads to the left first; a gap length found
    there also holds to the right.
    """
    seed = text[pos : pos + k]
    if len(seed) < k or (rule.primitive_only and not is_primitive(seed)):
        return None
    reader = _Reader(text, k, rule)
    before, start = reader.left(seed, pos)
    after, stop = reader.right(seed, pos + k)
    return start, before + after + 1, stop - 1


@dataclass
class Scan:
    """Repeats of one text, and what its neighbours need to know."""

    rows: list[tuple[int, int, int, int]] = field(default_factory=list)  # k, start, cnt, end
    marks: list[list[tuple[int, int]]] = field(default_factory=list)
    certain_to: int = 0


class _Lane:
    """Starts of one motif length, asked for in increasing order."""

    def __init__(self, text: str, k: int, rule: Rule, starts: Starts):
        self.text, self.k, self.rule = text, k, rule
        self.start = starts.start.tolist()
        self.more = starts
        self.at = 0
        # what follows a place depends on the gaps used only where their limit can be met
        self.known = {} if rule.max_gaps >= len(text) else None

    def next_start(self, pos: int) -> int:
        self.at = bisect_left(self.start, pos, self.at)
        return self.start[self.at] if self.at < len(self.start) else -1

    def run(self) -> tuple[int, int]:
        """(units, last position) of the run at the start found last."""
        i, p = self.at, self.start[self.at]
        reader = _Reader(self.text, self.k, self.rule, int(self.more.gap[i]), int(self.more.used[i]))
        found, stop = reader.right(self.text[p : p + self.k], int(self.more.cursor[i]), self.known)
        return self.rule.min_repeat + found, stop - 1


def scan_text(
    text: str, rule: Rule, borders=(), cut_short: bool = False, taken=None, starts=None
) -> Scan:
    """All repeats of ``text`` under ``rule``, read from left to right.

    ``borders`` are positions at which to note the reading state: per motif
    length, the next position to read and how far reported cells reach past
    the border. Two readings with the same state go on identically.
    ``cut_short`` says that the text goes on after its end; ``certain_to`` is
    then the position up to which that cannot have changed anything.
    ``taken`` is a byte per cell, set where the cell is covered beforehand.
    ``starts`` are the possible starts per motif length, if known.
    """
    if starts is None:
        codes, stops = to_codes(text), np.array([len(text)])
        starts = [possible_starts(codes, stops, k, rule) for k in rule.k_list]
    lanes = [_Lane(text, k, rule, found) for k, found in zip(rule.k_list, starts)]
    out = Scan(certain_to=len(text) - rule.reach if cut_short else len(text) + 1)
    if rule.policy == "position":
        _scan_by_position(lanes, rule, borders, cut_short, out)
        return out
    shared = taken if taken is not None else bytearray(len(text))
    for lane in lanes:
        cells = shared if rule.policy == "ranked" else bytearray(shared)
        _scan_one(lane, rule, cells, borders, cut_short, out)
    return out


def _scan_one(lane: _Lane, rule, cells, borders, cut_short, out: Scan):
    k = lane.k
    marks = [[b, -1] for b in borders]
    waiting = list(range(len(borders)))
    seen, free = 1, 0  # cells from seen up to free are covered; nothing known yet
    begun, filled = 0, 0  # the last stretch that was filled
    pos = 0
    while True:
        p = lane.next_start(pos)
        while waiting and (p < 0 or p >= borders[waiting[0]]):
            mark = marks[waiting.pop(0)]
            mark[0] = max(pos, mark[0])
        if p < 0:
            break
        cnt, end = lane.run()
        if cut_short and end + rule.step >= out.certain_to:
            out.certain_to = min(out.certain_to, p)
        if not seen <= p <= free:  # the next free cell is looked for once per covered stretch
            seen, free = p, cells.find(0, p)
            free = len(cells) if free < 0 else free
        if free > end:
            pos = p + 1
            continue
        if not begun <= p <= filled:
            begun, filled = p, p
        if end >= filled:  # what an overlapping report has filled stays
            cells[filled : end + 1] = b"\x01" * (end + 1 - filled)
            filled = end + 1
        seen, free = 1, 0
        out.rows.append((k, p, cnt, end))
        for mark, b in zip(marks, borders):
            if p < b <= end:
                mark[1] = max(mark[1], end)
        pos = p + 1 if rule.every_start else end - k + 1
    out.marks.append([tuple(m) for m in marks])


def _scan_by_position(lanes: list[_Lane], rule, borders, cut_short, out: Scan):
    ahead = [-2] * len(lanes)  # next start per lane, -1 when there is none
    marks = [[b, -1] for b in borders]
    waiting = list(range(len(borders)))
    pos = 0
    while True:
        for i, lane in enumerate(lanes):
            if ahead[i] != -1 and ahead[i] < pos:
                ahead[i] = lane.next_start(pos)
        ready = [(p, i) for i, p in enumerate(ahead) if p >= 0]
        p, i = min(ready) if ready else (-1, 0)
        while waiting and (p < 0 or p >= borders[waiting[0]]):
            mark = marks[waiting.pop(0)]
            mark[0] = max(pos, mark[0])
        if p < 0:
            break
        k = rule.k_list[i]
        cnt, end = lanes[i].run()
        if cut_short and end + rule.step >= out.certain_to:
            out.certain_to = min(out.certain_to, p)
        out.rows.append((k, p, cnt, end))
        pos = end - k + 1
    out.marks.append([tuple(m) for m in marks])


def text_repeats(text: str, rule: Rule) -> list[tuple[int, int, int, int]]:
    """(k, start, count, last position) of one text under any rule."""
    if not rule.exact or rule.policy == "position" or rule.every_start:
        return scan_text(text, rule).rows
    codes = to_codes(text)
    regions = []
    for k in rule.k_list:
        first, length = long_runs(same_after(codes, k), (rule.min_repeat - 1) * k)
        for a, m in zip(first.tolist(), length.tolist()):
            if not rule.primitive_only or is_primitive(text[a : a + k]):
                regions.append((k, a, m + k))
    if rule.policy == "ranked":
        found = exact_ranked(len(text), regions)
    else:
        found = [(k, a, length // k) for k, a, length in regions]
    return [(k, a, cnt, a + cnt * k - 1) for k, a, cnt in found]
