import random

import brute
import pytest
from helpers import log_frame, tuples

from driftline.operators.change_feed import replay

A = ("n", "a")


def state(spark, rows, **kw):
    return sorted(tuples(replay(log_frame(spark, rows), **kw), "namespace", "object_id", "seq"))


def u(seq, us, key=A, x=1.0, y=2.0, z=3.0):
    return (*key, "U", seq, us, x, y, z)


def t(seq, key=A, us=None):
    return (*key, "T", seq, us, None, None, None)


@pytest.mark.parametrize(
    ("rows", "last", "first"),
    [
        ([u(1, 5), t(2)], [], []),
        ([u(1, 1000), t(2), u(3, 9000)], [3], [3]),
        ([u(1, 10**15), t(2, us=5)], [], []),
        ([u(1, 9), u(2, 9), u(3, 3)], [2], [1]),
        ([u(1, 10), t(2), u(3, 5)], [3], [3]),
        ([u(3, 7), u(1, 9), u(2, 8)], [1], [1]),
        ([u(1, 9), u(1, 9), u(1, 9)], [1], [1]),
        ([t(1)], [], []),
        ([u(1, None), u(2, 5, x=float("nan")), u(3, 5, y=None), u(4, 4)], [4], [4]),
        ([u(1, 5, ("n", "")), u(2, 5, ("n", "a|b")), u(3, 5, ("n", "a::b")), u(4, 5, ("n", None)), u(5, 5, (None, "a"))], [], []),
        ([u(1, 5, ("n", "a\nb")), u(2, 5, ("n", "a\rb")), u(None, 5)], [], []),
    ],
)
def test_cases(spark, rows, last, first):
    assert [r[2] for r in state(spark, rows)] == last
    assert [r[2] for r in state(spark, rows, tie="first")] == first


def test_empty(spark):
    assert state(spark, []) == []


def test_same_id_in_two_namespaces(spark):
    assert state(spark, [u(1, 1, ("v", "a")), u(2, 1, ("d", "a")), t(3, ("v", "a"))]) == [("d", "a", 2)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("batches", [1, 3, 7])
def test_random_feeds(spark, seed, batches):
    rnd = random.Random(seed)
    rows = []
    for seq in range(1, 400):
        key = ("n", "hot" if rnd.random() < 0.4 else f"o{rnd.randrange(40)}")
        us = rnd.choice([None, rnd.randrange(50), seq])
        rows.append(t(seq, key, us) if rnd.random() < 0.1 else u(seq, us, key, x=rnd.choice([1.0, 2.0, None, 400.0])))
    rows += rnd.sample(rows, 60)
    rnd.shuffle(rows)
    names = ["namespace", "object_id", "op", "seq", "ts", "x", "y", "z"]
    want = sorted((*k, v["seq"]) for k, v in brute.replay([dict(zip(names, r, strict=True)) for r in rows]).items())
    assert state(spark, rows, batches=batches) == want


def test_base_rows(spark):
    base = replay(log_frame(spark, [u(1, 50, ("n", "old")), u(2, 50, ("n", "dead")), u(3, 50, ("n", "newer"))]))
    feed = log_frame(spark, [t(10, ("n", "dead")), u(11, 40, ("n", "newer")), u(12, 5, ("n", "fresh"))])
    got = sorted(tuples(replay(feed, base), "object_id", "seq"))
    assert got == [("fresh", 12), ("newer", 3), ("old", 1)]


def test_payload_survives(spark):
    rows = [(*A, "U", 1, 7, 1.0, 2.0, 3.0, '{"note":"a|b|c","n":1}')]
    assert tuples(replay(log_frame(spark, rows)), "x", "y", "z", "metadata") == [(1.0, 2.0, 3.0, '{"note":"a|b|c","n":1}')]


@pytest.mark.parametrize("tie", ["last", "first"])
def test_older_batches_are_left_fewer_rows(spark, tie):
    """Keys that are written again and again are resolved by the newest batches; late records keep theirs open."""
    rows = [u(i, i * 1000, ("n", f"o{i % 50}")) for i in range(1, 2001)]
    rows[100] = u(101, 10**9, ("n", "o1"))  # far ahead of its time: wins
    rows[1100] = t(1101, ("n", "o2"))
    rows[700] = u(701, 10**9, ("n", "o2"))  # as far ahead, but deleted
    left = {}
    got = tuples(replay(log_frame(spark, rows), batches=4, tie=tie, on_batch=lambda b, df: left.update({b: df.count()})), "object_id", "seq")
    want = brute.replay([dict(zip(["namespace", "object_id", "op", "seq", "ts", "x", "y", "z"], r, strict=True)) for r in rows])
    assert sorted(got) == sorted((k[1], r["seq"]) for k, r in want.items())
    assert left[3] >= 499
    assert max(left[b] for b in (0, 1, 2)) < 100


@pytest.mark.parametrize("tie", ["last", "first"])
@pytest.mark.parametrize("seed", range(3))
def test_onto_a_base(spark, seed, tie):
    rnd, rows = random.Random(seed), []
    for seq in range(1, 300):
        key = ("n", f"o{rnd.randrange(30)}")
        rows.append(t(seq, key) if rnd.random() < 0.2 else u(seq, rnd.randrange(40) + seq // 10, key))
    base = replay(log_frame(spark, rows[:150]), tie=tie)
    got = replay(log_frame(spark, rows[150:]), base, tie=tie, batches=3)
    assert sorted(tuples(got, "object_id", "seq")) == sorted(tuples(replay(log_frame(spark, rows), tie=tie), "object_id", "seq"))
