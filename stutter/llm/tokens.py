"""Tokens of texts, encoded in batches; repeated words are encoded once.

Texts are cut where a cut cannot change the tokens. What is cut off is looked
up in a memory of bounded size, and only new strings are encoded, together, in
batches balanced by bytes. The memory belongs to the Python worker and outlives
a task; when it is full, the strings used least are forgotten.
"""

from __future__ import annotations

import base64
import ctypes
import gc
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

KEPT = 300_000  # strings a worker remembers
_LONGEST_KEPT = 64  # bytes; longer strings are encoded each time
_BATCH = 1 << 18  # bytes encoded together
# a space before a character that is not white space; those outside ASCII begin with the bytes left out
_CUT = re.compile(rb" (?=[!-~\xc3-\xe0\xe4-\xff])")
# ASCII and the Latin-1 letters, whose classes no version of Unicode or of a pattern engine disputes
_PLAIN = bytes([*range(0xC0), 0xC3])


def _once(key: tuple, make):
    """A value that this Python process makes once; kept on an imported module, since tasks bring copies of this one."""
    kept = public_tokenizers.__dict__.setdefault("_made_once", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def trim() -> None:
    """Hand memory that is free in this process back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def release() -> None:
    """Drop what an earlier operator keeps in this Python process."""
    public_tokenizers.__dict__.pop("_made_once", None)
    trim()


def tokenizer(name: str):
    def make():
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use the cores
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(public_tokenizers.path(name))
        found.no_truncation()
        found.no_padding()
        return found

    return _once(("tokenizer", name), make)


def _ranks(name: str):
    """The same vocabulary for a faster encoder, where a rank file lies beside it."""
    def make():
        path = public_tokenizers.path(name.removesuffix(".json") + ".tiktoken")
        if not os.path.exists(path):
            return None
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return _once(("ranks", name), make)


def _batches(strings: list[bytes]):
    """Runs of strings with about the same number of bytes each."""
    lo, size = 0, 0
    for hi, s in enumerate(strings, 1):
        size += len(s) + 8
        if size >= _BATCH:
            yield strings[lo:hi]
            lo, size = hi, 0
    if lo < len(strings):
        yield strings[lo:]


def encode(name: str, strings: list[bytes]) -> list[list[int]]:
    out = []
    for part in _batches(strings):
        got = tokenizer(name).encode_batch_fast([s.decode("utf-8", "replace") for s in part], add_special_tokens=False)
        out.extend(e.ids for e in got)
    return out


def is_plain(text: bytes) -> bool:
    """Whether the rank file gives the tokens: characters of ``_PLAIN`` only and no special tokens."""
    return not text.translate(None, _PLAIN) and b"<|" not in text


def encode_plain(name: str, strings: list[bytes]) -> list[list[int]]:
    """:func:`encode`; plain strings go by the rank file."""
    fast = _ranks(name)
    if fast is None:
        return encode(name, strings)
    plain = [is_plain(s) for s in strings]
    slow = iter(encode(name, [s for s, p in zip(strings, plain, strict=True) if not p]))
    return [fast.encode_ordinary(s.decode()) if p else next(slow) for s, p in zip(strings, plain, strict=True)]


class Memory:
    """Numbers of known strings, and how often each was used."""

    def __init__(self, kept: int):
        self.kept = kept
        self.index: dict[bytes, int] = {}
        self.uses = np.zeros(1024, np.int64)

    def new(self, strings) -> list[bytes]:
        return [s for s in dict.fromkeys(strings) if s not in self.index]

    def add(self, strings: list[bytes]) -> None:
        self.index.update(zip(strings, range(len(self.index), len(self.index) + len(strings)), strict=True))
        if len(self.index) > len(self.uses):
            self.uses = np.concatenate([self.uses, np.zeros(len(self.index), np.int64)])

    def look_up(self, strings, n: int) -> np.ndarray:
        at = np.fromiter(map(self.index.__getitem__, strings), np.int64, n)
        self.uses[: len(self.index)] += np.bincount(at, minlength=len(self.index))
        return at

    def forget(self) -> np.ndarray | None:
        """Old numbers of the strings that stay, if some had to go; they are numbered anew."""
        n = len(self.index)
        if n <= self.kept:
            return None
        keep = np.sort(np.argsort(-self.uses[:n], kind="stable")[: self.kept * 3 // 4])
        names = list(self.index)
        names = [names[i] for i in keep if len(names[i]) <= _LONGEST_KEPT]
        keep = np.array([self.index[s] for s in names], np.int64)
        self.index = dict(zip(names, range(len(names)), strict=True))
        self.uses = np.concatenate([self.uses[keep] // 2, np.zeros(1024, np.int64)])
        return keep


class Counter:
    """Token counts of texts whose tokenizer drops white space and never joins words across it.

    Cuts at ASCII white space are safe: the pattern matches none of it, composed
    characters and special strings do not reach over it.
    """

    def __init__(self, name: str, kept: int = KEPT):
        self.name, self.memory = name, Memory(kept)
        self.sizes = np.zeros(0, np.int64)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        parts = [t.split() for t in texts]
        stay = self.memory.forget()
        if stay is not None:
            self.sizes = self.sizes[stay]
        new = self.memory.new(itertools.chain.from_iterable(parts))
        fresh = np.fromiter(map(len, encode(self.name, new)), np.int64, len(new))
        self.memory.add(new)
        self.sizes = np.concatenate([self.sizes, fresh])
        words = np.fromiter(map(len, parts), np.int64, len(parts))
        at = self.memory.look_up(itertools.chain.from_iterable(parts), int(words.sum()))
        total = np.concatenate([[0], np.cumsum(self.sizes[at])])
        ends = np.concatenate([[0], np.cumsum(words)])
        return total[ends[1:]] - total[ends[:-1]]


class Encoder:
    """Token ids of texts under a byte-level tokenizer that joins one space to the word behind it.

    A cut before a space that has a character other than white space behind it
    is safe: every match that takes such a space begins with it.
    """

    def __init__(self, name: str, kept: int = KEPT):
        self.name, self.memory = name, Memory(kept)
        self.ids = np.zeros(0, np.uint32)
        self.sizes = np.zeros(0, np.int64)

    @staticmethod
    def cut(text: bytes) -> list[bytes]:
        """Pieces that can be encoded on their own."""
        first, *rest = _CUT.split(text)
        rest = [b" " + p for p in rest]
        return [first, *rest] if first else rest

    @staticmethod
    def parts(text: bytes) -> Iterator[bytes]:
        """A long text in parts of about ``_BATCH`` bytes, cut where it is safe."""
        lo = 0
        while len(text) - lo > _BATCH and (at := _CUT.search(text, lo + _BATCH)):
            yield text[lo : at.start()]
            lo = at.start()
        yield text[lo:]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each has.

        Plain texts are encoded whole, which is faster than looking up their
        words; the memory serves the others.
        """
        fast = _ranks(self.name)
        plain = np.array([fast is not None and is_plain(t) for t in texts], bool)
        others = [t for t, p in zip(texts, plain.tolist(), strict=True) if not p]
        flat, sizes = self._by_pieces(others) if others else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if len(others) == len(texts):
            return flat, sizes
        ends, at, out, counts = np.cumsum(sizes), 0, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if plain[i]:
                got = [np.array(fast.encode_ordinary(part.decode()), np.uint32) for part in self.parts(text)]
            else:
                got = [flat[ends[at] - sizes[at] : ends[at]]]
                at += 1
            out += got
            counts[i] = sum(map(len, got))
        return np.concatenate(out), counts

    def _by_pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [self.cut(t) for t in texts]
        stay = self.memory.forget()
        if stay is not None:
            self.ids, self.sizes = self._gather(stay), self.sizes[stay]
        new = self.memory.new(itertools.chain.from_iterable(pieces))
        fresh = encode_plain(self.name, new)
        self.memory.add(new)
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        flat = np.fromiter(itertools.chain.from_iterable(fresh), np.uint32, int(sizes.sum()))
        self.ids, self.sizes = np.concatenate([self.ids, flat]), np.concatenate([self.sizes, sizes])
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = self.memory.look_up(itertools.chain.from_iterable(pieces), int(counts.sum()))
        total = np.concatenate([[0], np.cumsum(self.sizes[at])])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self._gather(at), np.diff(total[ends])

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of the strings with these numbers, end to end."""
        size = self.sizes[at]
        ends = np.cumsum(size)
        begin = np.cumsum(self.sizes) - self.sizes
        return self.ids[np.repeat(begin[at] - (ends - size), size) + np.arange(int(size.sum()))]


def counter(name: str) -> Counter:
    return _once(("counter", name), lambda: Counter(name))


def encoder(name: str) -> Encoder:
    return _once(("encoder", name), lambda: Encoder(name))
