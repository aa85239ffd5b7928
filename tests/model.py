"""Slow model of the reading rules, one character at a time; only for tests."""

from __future__ import annotations

FAR = 10**7


def primitive(w):
    return not any(len(w) % d == 0 and w == w[:d] * (len(w) // d) for d in range(1, len(w)))


def _fits(text, seed, at, miss):
    k = len(seed)
    if at < 0 or at + k > len(text):
        return False
    return sum(a == b for a, b in zip(text[at : at + k], seed)) >= k - miss


def extend(text, p, k, miss=0, max_gap=0, max_gaps=FAR):
    """(units, last position) of the run that begins at p, or None without a seed."""
    n = len(text)
    seed = text[p : p + k]
    if len(seed) < k or not primitive(seed):
        return None
    cnt, q, gap, used = 1, p + k, 0, 0
    while q + k <= n:
        jump = None
        if _fits(text, seed, q, miss):
            jump = 0
        elif used < max_gaps:
            if gap == 0:
                jump = next((g for g in range(1, max_gap + 1) if _fits(text, seed, q + g, miss)), None)
                gap = jump or 0
            elif q + gap + k < n and _fits(text, seed, q + gap, miss):
                jump = gap
            used += jump is not None
        if jump is None:
            break
        cnt, q = cnt + 1, q + jump + k
    return cnt, q - 1


def around(text, p, k, min_repeat=3, miss=0, max_gap=0, max_gaps=FAR):
    """(start, units, last position) of the run through p, or None."""
    n = len(text)
    seed = text[p : p + k]
    if len(seed) < k or not primitive(seed):
        return None
    cnt, gap, used = 1, 0, 0
    low = p - k
    while low >= 0:
        if _fits(text, seed, low, miss):
            cnt, low = cnt + 1, low - k
            continue
        if used >= max_gaps:
            break
        tries = [gap] if gap else list(range(1, max_gap + 1))
        found = next((g for g in tries if _fits(text, seed, low - g, miss)), None)
        if found is None:
            break
        gap, used, cnt, low = found, used + 1, cnt + 1, low - k - found
    q = p + k
    while q + k <= n:
        if _fits(text, seed, q, miss):
            cnt, q = cnt + 1, q + k
            continue
        if used >= max_gaps:
            break
        if gap:
            found = gap if q + gap + k < n and _fits(text, seed, q + gap, miss) else None
        else:
            found = next((g for g in range(1, max_gap + 1) if _fits(text, seed, q + g, miss)), None)
        if found is None:
            break
        gap, used, cnt, q = found, used + 1, cnt + 1, q + k + found
    return (low + k, cnt, q - 1) if cnt >= min_repeat else None


def read(text, ks, min_repeat=3, miss=0, max_gap=0, max_gaps=FAR, policy="ranked", every_start=False, covered=None):
    """(k, motif, units, start, last position) in report order."""
    out = []
    if policy == "position":
        pos = 0
        while pos < len(text):
            for k in ks:
                run = extend(text, pos, k, miss, max_gap, max_gaps)
                if run and run[0] >= min_repeat:
                    out.append((k, text[pos : pos + k], run[0], pos, run[1]))
                    pos = run[1] - k + 1
                    break
            else:
                pos += 1
        return out
    cells = set(covered or ())
    for k in ks:
        if policy == "separate":
            cells = set(covered or ())
        pos = 0
        while pos < len(text):
            run = extend(text, pos, k, miss, max_gap, max_gaps)
            if run is None or run[0] < min_repeat:
                pos += 1
                continue
            mine = set(range(pos, run[1] + 1))
            if mine <= cells:
                pos += 1
                continue
            cells |= mine
            out.append((k, text[pos : pos + k], run[0], pos, run[1]))
            pos = pos + 1 if every_start else run[1] - k + 1
    return out


def texts(rnd, count, longest=60):
    """Random texts with many repeats of many kinds."""

    def one():
        t = rnd.random()
        if t < 0.4:
            return "".join(rnd.choice("ab") for _ in range(rnd.randint(0, longest)))
        if t < 0.6:
            return "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, longest)))
        parts = []
        for _ in range(rnd.randint(1, max(2, longest // 10))):
            w = "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 7)))
            parts.append((w * rnd.randint(1, 8))[: rnd.randint(1, 40)] + rnd.choice(["", "x", "xy"]))
        return "".join(parts)

    return [one() for _ in range(count)]
