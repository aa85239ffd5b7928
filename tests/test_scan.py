"""In-task readers against the slow model, and golden rows."""

import random

import model
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stutter.functions.scan import Rule, _Reader, is_primitive, run_around, scan_text, text_repeats

# fixed values: sample strings and golden rows
S1 = (
    "TATTTTGCTCGCTGCTGCTCTGATATGACTCACAACCCCCGCTCCCGGTGTTCATCAGACGTTCGGTACACATAATAATAAATGAACATTCCGCGGGCGAGACGGAAAGC"
    "AACACAGGTCCCAGGGAGGGCGAAAAAGTGAAAAAAAGAGGGGGGGTCGAAATTTAATGATCGGGATAGTAAATAGAGCACAAATCATAATAAGAGGGGG"
)
S2 = "acacacxdxxdxxdxcccvcvcvcabcdeabcdeabcdebbbbbbbbccAacacacTAacacacTAacacacTA"
S3 = S2[:-1]
LONG_LIST = [
    ("abcde", 3, 24, 38), ("xdx", 3, 6, 14), ("ac", 3, 0, 5), ("cv", 3, 17, 22),
    ("ac", 3, 50, 55), ("ac", 3, 58, 63), ("ac", 3, 66, 71),
]
EIGHT_LIST = [("AacacacT", 3, 49, 72), ("abcde", 3, 24, 38), ("xdx", 3, 6, 14), ("ac", 3, 0, 5), ("cv", 3, 17, 22)]
SHIFT = [
    ("a", 3, 0, 2), ("b", 3, 3, 5), ("a", 3, 6, 8), ("b", 3, 9, 11), ("a", 3, 12, 14), ("b", 3, 15, 17),
    ("aabbba", 3, 1, 18),
]
GOLDEN = [
    (S1, (6,), []),
    (S1, (6, 5, 4, 3, 2), [("GCT", 3, 10, 18), ("ATA", 3, 71, 79)]),
    (S1, (8, 5, 3, 2), [("GCT", 3, 10, 18), ("ATA", 3, 71, 79)]),
    (S2, (6,), []), (S3, (6,), []),
    (S2, (6, 5, 4, 3, 2), LONG_LIST), (S3, (6, 5, 4, 3, 2), LONG_LIST),
    (S2, (8, 5, 3, 2), EIGHT_LIST), (S3, (8, 5, 3, 2), EIGHT_LIST),
    ("ababababab", (4, 2), [("ab", 5, 0, 9)]), ("ababababab", (2, 4), [("ab", 5, 0, 9)]),
    ("abcabcabcab", (3,), [("abc", 3, 0, 8)]),
    ("aaabbbaaabbbaaabbbaa", (1, 6), SHIFT),
]
TOLERANT = [
    ("abcabdabc", 1, 0, [("abc", 3, 0, 8)]),
    ("abcXabcXabc", 0, 1, []), ("abcXabcXabc", 0, 2, []),
    ("abcXabcabcXabc!", 0, 1, [("abc", 4, 0, 13)]),
    ("abcXabcYYabcabc", 0, 2, [("abc", 3, 4, 14)]),
]


@pytest.mark.parametrize("text,ks,rows", GOLDEN)
def test_golden(text, ks, rows):
    for reader in (lambda t, r: scan_text(t, r).rows, text_repeats):
        got = [(text[p : p + k], cnt, p, end) for k, p, cnt, end in reader(text, Rule(ks))]
        assert got == rows


@pytest.mark.parametrize("text,miss,gap,rows", TOLERANT)
def test_golden_tolerant(text, miss, gap, rows):
    got = scan_text(text, Rule((3,), 3, miss, gap)).rows
    assert [(text[p : p + k], cnt, p, end) for k, p, cnt, end in got] == rows


def extend_right(text, start, k, rule):
    """(units, last position) of the run that begins at ``start``."""
    found, stop = _Reader(text, k, rule).right(text[start : start + k], start + k)
    return found + 1, stop - 1


def test_golden_extension():
    assert extend_right(S1, 71, 3, Rule((3,))) == (3, 79)
    assert extend_right(S1, 71, 3, Rule((3,), 3, 1, 1)) == (5, 87)
    s4 = "abcaccabcdabcabc"
    assert extend_right(s4, 0, 3, Rule((3,)))[0] < 3
    assert extend_right(s4, 0, 3, Rule((3,), 3, 1, 1)) == (5, 15)


def test_primitive():
    # fixed values
    words = {
        "AAAAC": True, "abab": False, "aabaab": False, "a": True, "aabaaaba": False, "abaababaab": False,
    }
    for word, wanted in words.items():
        assert is_primitive(word) is wanted
    for word in ("aabaaaba", "abaababaab", "abaaba", "xdxxdx"):
        assert is_primitive(word) == model.primitive(word)


@settings(max_examples=600, deadline=None)
@given(
    st.text(alphabet="abc", max_size=50), st.lists(st.integers(1, 6), min_size=1, max_size=3),
    st.integers(2, 4), st.integers(0, 2), st.integers(0, 3), st.sampled_from([0, 1, 2, 10**7]),
    st.sampled_from(["ranked", "separate", "position"]), st.booleans(),
)
def test_reader_is_the_model(text, ks, r, miss, gap, gaps, policy, every):
    every = every and policy == "separate"
    rule = Rule(tuple(ks), r, miss, gap, gaps, policy=policy, every_start=every)
    want = model.read(text, ks, r, miss, gap, gaps, policy, every)
    for reader in (lambda t, r: scan_text(t, r).rows, text_repeats):
        assert [(k, text[p : p + k], cnt, p, end) for k, p, cnt, end in reader(text, rule)] == want
    for p in range(len(text)):
        run = run_around(text, p, ks[0], rule)
        run = run if run and run[1] >= r else None
        assert run == model.around(text, p, ks[0], r, miss, gap, gaps)


def test_mask():
    rnd = random.Random(5)
    for text in model.texts(rnd, 300):
        covered = {i for i in range(len(text)) if rnd.random() < 0.7}
        taken = bytearray(1 if i in covered else 0 for i in range(len(text)))
        got = scan_text(text, Rule((3, 2, 1)), taken=taken).rows
        assert [(k, text[p : p + k], c, p, e) for k, p, c, e in got] == model.read(text, (3, 2, 1), covered=covered)


def test_rule_is_checked():
    for bad in (dict(k_list=()), dict(k_list=(0,)), dict(k_list=(2,), min_repeat=1), dict(k_list=(2,), policy="x")):
        with pytest.raises(ValueError):
            Rule(**bad)


def test_long_runs_inside_covered_text():
    rnd = random.Random(9)
    for _ in range(40):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(2, 5)))
        text = list((word + rnd.choice(["", "x"])) * rnd.randint(20, 60))
        for _ in range(rnd.randint(0, 6)):
            text[rnd.randrange(len(text))] = rnd.choice("abcx")
        text = "".join(text)
        for miss, gap, gaps in ((0, 1, 10**7), (1, 1, 10**7), (1, 2, 3), (0, 0, 10**7)):
            rule = Rule((4, 3, 2, 5), 3, miss, gap, gaps)
            got = [(k, text[p : p + k], c, p, e) for k, p, c, e in scan_text(text, rule).rows]
            assert got == model.read(text, (4, 3, 2, 5), 3, miss, gap, gaps)
