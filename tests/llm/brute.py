"""Slow versions of the operators, written from their definitions."""

import hashlib
import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall(text or "")


def substring_dedup(rows, window=50):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_components(rows):
    sets = [(doc, shingles(text)) for doc, text in rows]
    label = {doc: doc for doc, _ in sets if doc is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return [(doc, len(s), None if doc is None else root(doc)) for doc, s in sets]


def tokens(text):
    import regex

    alone = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"  # a character is a token
    return regex.findall(rf"(?=[{alone}])[\p{{L}}\p{{N}}]|(?:(?![{alone}])[\p{{L}}\p{{N}}])+", (text or "").lower())


def contaminated(text, items):
    """Ids of the items that the text overlaps with."""
    t = tokens(text)
    found = set()
    for item, body in items:
        b = tokens(body)
        if not b:
            continue
        size = min(13, len(b))
        allowed = 2 if len(b) >= 13 else 1 if len(b) >= 8 else 0
        for i in range(len(t) - size + 1):
            for j in range(len(b) - size + 1):
                if sum(x != y for x, y in zip(t[i : i + size], b[j : j + size], strict=True)) <= allowed:
                    found.add(item)
    return sorted(found)


def languages(taught, texts, rarest):
    """Language, score and margin (in log units) of each text; learned from all of ``taught``, (text, language)."""
    import math
    from collections import Counter

    runs = re.compile(r"[^\W\d_]+")
    langs = sorted({la for _, la in taught})
    words, grams = {la: Counter() for la in langs}, {la: Counter() for la in langs}
    for text, la in taught:
        for w in runs.findall(text.lower()):
            words[la][w] += 1
            m = f"<{w}>"
            grams[la].update(m[i : i + n] for n in (1, 2, 3, 4) for i in range(len(m) - n + 1))

    def scored(counts, totals):
        known = {
            x for la in langs for x, n in counts[la].items()
            if sum(counts[o][x] for o in langs) > 1 and any(counts[o][x] * rarest >= sum(counts[o].values()) for o in langs)
        }
        if totals is None:
            totals = {la: sum(n for x, n in counts[la].items() if x in known) for la in langs}
        return {
            x: [math.log(counts[la][x] + 0.5) - math.log(totals[la] + 0.5 * max(1, len(known))) for la in langs] for x in known
        }

    by_word = scored(words, {la: sum(words[la].values()) for la in langs})
    by_gram = scored(grams, None)

    def of(w):
        if w in by_word:
            return by_word[w]
        total, m = [0.0] * len(langs), f"<{w}>"
        while m:
            n = next((n for n in (4, 3, 2, 1) if m[:n] in by_gram), 0)
            if n:
                total = [a + b for a, b in zip(total, by_gram[m[:n]], strict=True)]
            m = m[max(1, n):]
        return total

    out, memory = [], {}
    for text in texts:
        found = runs.findall((text or "").lower())
        if not any(c.isalpha() for w in found for c in w):
            out.append(("und", 0.0, math.inf))
            continue
        total = [0.0] * len(langs)
        for w in found:
            if w not in memory:
                memory[w] = of(w)
            total = [a + b for a, b in zip(total, memory[w], strict=True)]
        top = sorted(total, reverse=True)
        out.append((langs[total.index(top[0])], 1 / sum(math.exp(x - top[0]) for x in total), (top + [-math.inf])[0] - (top + [-math.inf])[1]))
    return out


def top_k(rows, k=5, every=50):
    import math
    from fractions import Fraction

    ok = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, v) in enumerate(ok):
        if q % every or (q, v) in ok[:own]:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), c) for at, (c, w) in enumerate(ok) if at != own]  # noqa: B905
        scores = sorted((-max(-(2**63), min(2**63 - 1, s)), c) for s, c in scores)
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def runs(w, least, times):
    """(start, length, period) of maximal runs, every period tried at every place."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)  # smaller periods come first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]
