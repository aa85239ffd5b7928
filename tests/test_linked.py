"""Tolerant runs that are far longer than the ranges they are read in."""

import random

import model
import pytest
from helpers import expected, pieces, repeat_rows, sequences

from stutter.functions import carry
from stutter.functions.scan import Rule
from stutter.operators import linked, tolerant
from stutter.operators.linked import read_linked
from stutter.operators.tolerant import tolerant_repeats


def array(rng, unit, copies, faults, gaps):
    """Copies of a unit with single characters exchanged and inserted."""
    body = list(unit * copies)
    for _ in range(faults):
        body[rng.randrange(len(body))] = rng.choice("abcX")
    for _ in range(gaps):
        body.insert(rng.randrange(len(body)), "Y")
    return "".join(body)


def test_passages():
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 40)))
        if rng.random() < 0.6:
            text = (text[: rng.randrange(1, 5)] * 30)[: rng.randrange(5, 60)]
        k, gap = rng.randrange(1, 5), rng.randrange(3)
        rule = Rule((k,), 3, rng.randrange(2), gap)
        size = rng.randrange(rule.step, 30)
        cut = len(text) >= size + rule.step
        text = text[: size + rule.step] if cut else text
        seed = "".join(rng.choice("ab") for _ in range(k))
        got = carry.passage(text, seed, rule, size, rule.step, cut)
        for c in range(carry.SHUT, gap + 1):
            mine = rule if c >= 0 else Rule((k,), 3, rule.miss, gap, 0)
            for entry in range(min(rule.step, len(text) + 1)):
                units, at, left, used, ended = carry.walk(text, entry, seed, max(c, 0), 0, mine, cut, size)
                cell = (c + 1, entry)
                assert (got.units[cell], got.at[cell] + (0 if ended else size), got.used[cell], got.ended[cell]) == (units, at, used, ended)
                assert c < 0 or got.gap[cell] == left


TEXTS = [
    "xyz" + array(random.Random(2), "abc", 2000, 40, 0) + "zyx" * 40,  # 6,000 characters
    array(random.Random(3), "ab", 900, 10, 3) + "q" + array(random.Random(4), "aab", 700, 9, 2),
    "a" * 2000, "", "abXabXab", model.texts(random.Random(5), 1, 160)[0] * 9,
]


@pytest.mark.parametrize(
    "ks,miss,gap,gaps,policy", [((3, 2), 1, 1, 10_000_000, "ranked"), ((2, 1), 0, 2, 2, "separate"), ((1, 2, 3), 0, 1, 10_000_000, "position")]
)
def test_runs_over_many_ranges(spark, monkeypatch, ks, miss, gap, gaps, policy):
    read = []
    monkeypatch.setattr(tolerant, "_MOST_JOINED", 2)
    monkeypatch.setattr(tolerant, "read_linked", lambda *a: read.append(1) or read_linked(*a))
    want = expected(TEXTS, ks, 3, miss, gap, gaps, policy=policy)
    assert repeat_rows(tolerant_repeats(sequences(spark, TEXTS), Rule(ks, 3, miss, gap, gaps, policy=policy), 256, 64)) == want
    assert read


def test_pieces(spark):
    want = expected(TEXTS[:2], (3,), 3, 1)
    assert repeat_rows(read_linked(pieces(spark, TEXTS[:2], 50), Rule((3,), 3, 1), 256, 64)) == want


class Mapped:
    """In place of a DataFrame: hands back the task function."""

    def mapInArrow(self, read, schema):
        return read

    def repartition(self, *by):
        return self

    sortWithinPartitions = repartition


def test_ranges_are_read_together(spark):
    schema = linked._arrow(linked._READ, spark)
    read = linked._read(Mapped(), Rule((3,), 3, 1), [[3]], 24, 20, schema)
    entry = "array<struct<k:int,seed:string,gap:int,used:bigint,stop:bigint,units:bigint,end_pos:bigint,free:bigint>>"
    arrow = linked._arrow(
        "seq_id long, seq_name string, lane int, chunk_id long, text string, text_start long, "
        f"state {linked._STATE}, mask array<struct<s:bigint,e:bigint>>, ends {entry}", spark
    )
    at_start = {"pos": 0, "reach": -1, "free": 0}
    rows = [(i, f"seq{i}", 0, 0, "abcabcabcq" if i % 2 else "abXabqabc", 0, at_start, None, None) for i in range(1000)]
    got = list(read(iter([linked._batch(rows, arrow)])))
    assert len(got) == 1  # not a batch for each range
    found = [r for r in got[0].to_pylist() if r["kind"] == "repeat"]
    assert [(r["seq_id"], r["cnt"]) for r in found] == [(i, 3) for i in range(1000)]


def test_plan_goes_on_over_batches(spark):
    plan = linked._planned(Mapped(), 10, linked._arrow(linked._PLAN, spark))
    arrow = linked._arrow(f"seq_id long, lane int, chunk_id long, asked boolean, entered {linked._STATE}, left {linked._STATE}", spark)
    state = lambda pos: {"pos": pos, "reach": -1, "free": 0}
    one = [(1, 0, 0, False, state(0), state(25)), (1, 0, 1, False, state(10), state(20)), (1, 0, 2, False, state(20), state(30))]
    rows = one + [(2, *r[1:]) for r in one]
    for cut in range(len(rows) + 1):
        batches = [linked._batch(part, arrow) for part in (rows[:cut], rows[cut:]) if part]
        got = [r for b in plan(iter(batches)) for r in b.to_pylist()]
        assert [(r["seq_id"], r["chunk_id"], r["valid"], r["again"]) for r in got] == [
            (i, c, c != 1, c == 2) for i in (1, 2) for c in range(3)
        ]
        assert [r["state"] for r in got if r["again"]] == [state(25)] * 2
