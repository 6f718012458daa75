import pytest

from driftline.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"
SIZES = "doc_id bigint, source string, tokens bigint"


def share(name, target, size, cap):
    return mixing.Share(name, target, size, cap)


def test_nothing_is_clamped():
    got = mixing.fill([share("a", 0.75, 1000, 1), share("b", 0.25, 1000, 1)], 1000)
    assert [s.amount for s in got] == [750, 250]


def test_excess_goes_to_the_others_in_proportion():
    got = mixing.fill([share("a", 0.5, 100, 2), share("b", 0.3, 10_000, 1), share("c", 0.2, 10_000, 1)], 1000)
    assert [s.amount for s in got] == [200, pytest.approx(480), pytest.approx(320)]


def test_clamping_cascades_and_may_fall_short():
    got = mixing.fill([share("a", 0.6, 100, 1), share("b", 0.3, 300, 1), share("c", 0.1, 5_000, 1), share("none", 0.1, 0, 9)], 1000)
    assert [s.amount for s in got] == [100, 300, 600, 0]
    got = mixing.fill([share("a", 0.5, 10, 3), share("b", 0.5, 10, 1)], 1000)
    assert [s.amount for s in got] == [30, 10]
    assert mixing.fill([], 5) == []
    assert [s.amount for s in mixing.fill([share("a", 0.0, 10, 3), share("b", 1.0, 10, 0)], 10)] == [0, 0]


def frames(spark, docs, targets):
    return spark.createDataFrame(docs, SIZES), spark.createDataFrame(targets, TARGETS)


def test_shares_are_met(spark):
    docs = [(i, "big" if i % 10 else "small", 50 + i % 7) for i in range(20_000)]
    sizes, targets = frames(spark, docs, [(" Big", 0.6, 1), ("SMALL ", 0.4, 2), ("absent", 0.0, 5), (None, 0.5, 5)])
    plan = mixing.plan(sizes, targets, total=500_000)
    used = mixing.repeats(sizes, plan)
    rows = {r.source: r for r in mixing.report(used, plan).collect()}
    assert set(rows) == {"big", "small", "absent"}
    small = next(s for s in plan if s.source == "small")
    assert small.amount == pytest.approx(min(200_000, small.limit))
    assert rows["big"].actual_tokens + rows["small"].actual_tokens == pytest.approx(500_000, rel=0.002)
    assert rows["small"].most_repeats <= 2 and rows["big"].most_repeats <= 1
    assert sum(r.actual_share for r in rows.values()) == pytest.approx(1.0)
    again = mixing.repeats(sizes.repartition(7), mixing.plan(sizes.repartition(3), targets, total=500_000))
    assert sorted(map(tuple, used.collect())) == sorted(map(tuple, again.collect()))


def test_cap_is_used_whole(spark):
    sizes, targets = frames(spark, [(1, "a", 10), (2, "a", 10), (3, "other", 99), (4, None, 5)], [("a", 1.0, 3)])
    plan = mixing.plan(sizes, targets, total=1_000)
    assert sorted((r.doc_id, r.repeats) for r in mixing.repeats(sizes, plan).collect()) == [(1, 3), (2, 3)]


def test_empty(spark):
    sizes, targets = frames(spark, [], [])
    plan = mixing.plan(sizes, targets)
    assert plan == []
    assert mixing.repeats(sizes, plan).collect() == []
    assert mixing.report(mixing.repeats(sizes, plan), plan).collect() == []
    sizes, targets = frames(spark, [(1, "a", 0)], [("a", 1.0, 3)])
    assert mixing.repeats(sizes, mixing.plan(sizes, targets)).collect() == []


def test_source_key(spark):
    df = spark.createDataFrame([(" Hub\t",), ("HUB",), (None,), ("  ",)], "source string")
    assert [r[0] for r in df.select(mixing.source_key("source")).collect()] == ["hub", "hub", None, ""]
