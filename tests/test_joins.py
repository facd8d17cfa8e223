"""Joins in time against nested loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import joins as J
from marketloom.plans import queries

START = dt.datetime(2025, 1, 1)


def at(minutes):
    return None if minutes is None else START + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def sides(spark):
    """Two keys, a hot one with most rows, ties, gaps of weeks, repeated rows, nulls in keys and moments."""
    rng = random.Random(3)
    moment = lambda: rng.choice([rng.randrange(0, 3000), rng.randrange(0, 90_000), 1440, None])
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    left = [(i, key(), at(moment())) for i in range(150)]
    left += left[:5]
    right = [(key(), at(moment()), rng.randrange(4), k) for k in range(120)]
    return left, right, spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "k string, at timestamp, tie int, v int")


@pytest.mark.parametrize("seconds", [600, J.DAY, 400 * J.DAY])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("within", [None, 3600])
def test_asof(sides, seconds, forward, within):
    left, right, l, r = sides

    def best(k, t):
        if k is None or t is None:
            return None
        found = [x for x in right if x[0] == k and x[1] is not None and (x[1] >= t if forward else x[1] <= t)]
        one = (min if forward else max)(found, key=lambda x: (x[1], x[2], x[3]), default=None)
        return None if one is None or within is not None and abs((one[1] - t).total_seconds()) > within else (one[1], one[2], one[3])

    got = J.asof(l, r, ("k",), "t", "at", ("tie",), forward=forward, seconds=seconds, within=within)
    assert got.columns == ["id", "k", "t", "found"]
    assert sorted((x.id, str(x.t), tuple(x.found) if x.found else None) for x in got.collect()) == sorted((i, str(t), best(k, t)) for i, k, t in left)


def test_asof_empty(sides):
    left, _, l, r = sides
    assert J.asof(l.limit(0), r, ("k",), "t", "at").count() == 0
    none = J.asof(l, r.limit(0), ("k",), "t", "at")
    assert none.count() == len(left) and none.where("found is not null").count() == 0


def test_asof_reads_no_later_row(spark):
    """A row at the very moment counts, one a microsecond later doesn't, on both sides of the bound of a stretch."""
    t = dt.datetime(2025, 1, 2)
    l = spark.createDataFrame([(0, "k", t - dt.timedelta(microseconds=1)), (1, "k", t), (2, "k", t + dt.timedelta(microseconds=1))], "id int, k string, t timestamp_ntz")
    r = spark.createDataFrame([("k", t, 1), ("k", t + dt.timedelta(microseconds=1), 2)], "k string, at timestamp_ntz, v int")
    find = lambda **how: [x.found.v if x.found else None for x in J.asof(l, r, ("k",), "t", "at", **how).orderBy("id").collect()]
    assert find() == [None, 1, 2] and find(forward=True) == [1, 1, 2]


@pytest.mark.parametrize("seconds", [300, 7200, 100 * J.DAY])
def test_meeting(spark, seconds):
    rng = random.Random(9)

    def intervals(n, name):
        rows = [(name + str(i), rng.choice(["hot", "hot", "b", None]), at(rng.choice([rng.randrange(0, 4000), None, 600])), rng.choice([0, 30, 500, -5])) for i in range(n)]
        return [(i, k, s, None if s is None else s + dt.timedelta(minutes=d)) for i, k, s, d in rows]

    a, b = intervals(60, "a"), intervals(60, "b")
    l, r = spark.createDataFrame(a, "a string, k string, s timestamp, e timestamp"), spark.createDataFrame(b, "b string, k string, s2 timestamp, e2 timestamp")
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and None not in (x[2], y[2]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    got = J.meeting(l, r, ("k",), "s", "e", "s2", "e2", seconds)
    assert got.columns == ["a", "k", "s", "e", "b", "s2", "e2"] and sorted((x.a, x.b) for x in got.collect()) == want and len(want) > 20
    points = sorted((x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and None not in (x[2], y[2]) and x[2] <= y[2] <= x[3])
    assert sorted((x.a, x.b) for x in J.meeting(l, r.drop("e2"), ("k",), "s", "e", "s2", seconds=seconds).collect()) == points
    assert J.meeting(l.limit(0), r, ("k",), "s", "e", "s2").count() == 0
    with pytest.raises(ValueError):
        J.meeting(l, r.withColumn("a", F.lit(1)), ("k",), "s", "e", "s2")


def test_plans(spark):
    """No cartesian product, nested loop or join of the whole history of a symbol: keys of exchanges have the stretch."""
    for name in ("headline_returns", "headline_windows"):
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        assert "_b" in plan
