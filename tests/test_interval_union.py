import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterframe.operators.interval_union import interval_gaps, interval_periods, merge_sorted_groups, to_ms

S, E = "s", "e"


def brute(rows):
    periods = {}
    for k in {r[0] for r in rows}:
        out = []
        for a, b in sorted((a, b) for key, a, b in rows if key == k and a is not None and b is not None and b > a):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        if out:
            periods[k] = out
    return {(k, a, b) for k, p in periods.items() for a, b in p}, {(k, x[1], y[0]) for k, p in periods.items() for x, y in zip(p, p[1:])}


@pytest.mark.parametrize("block", [50, 400, 100_000])
def test_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = []
    for _ in range(600):
        a = rng.randrange(3000)
        rows.append((rng.choice(["x", "y", None]), a, rng.choice([a + rng.randrange(1, 12), a + 700, a - 3, None])))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "k string, s long, e long").repartition(5)
    periods, gaps = brute(rows)
    got = {tuple(r) for r in interval_periods(df, ["k"], F.col(S), F.col(E), block_ms=block).collect()}
    assert got == periods
    got = {tuple(r) for r in interval_gaps(df, ["k"], F.col(S), F.col(E), block_ms=block).collect()}
    assert got == gaps


def test_limits_ties_and_clashing_columns(spark):
    rows = [("a", 0, 10, 1), ("a", 10, 20, 1), ("a", 25, 30, 2), ("a", 25, 30, 2), ("a", 100, 101, 3)]
    df = spark.createDataFrame(rows, "k string, s long, e long, starts long")
    assert {tuple(r) for r in interval_gaps(df, ["k"], F.col(S), F.col(E), min_ms=5, below_ms=70).collect()} == {("a", 20, 25)}
    assert interval_gaps(df, ["k"], F.col(S), F.col(E), min_ms=6, below_ms=70).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "k string, s long, e long")
    assert interval_gaps(df, ["k"], F.col(S), F.col(E)).collect() == [] and interval_periods(df, ["k"], F.col(S), F.col(E)).collect() == []


def test_to_ms(spark):
    df = spark.createDataFrame([(1.2344999,), (None,), (float("nan"),), (float("inf"),), (0.0,)], "x double")
    assert [r[0] for r in df.select(to_ms(F.col("x"))).collect()] == [1234, None, None, None, 0]


def test_merge_of_large_bounds():
    big = np.array([10**15, 5, 10**15 + 1])
    c, s, e = merge_sorted_groups(np.array([1, 0, 1]), big, big + 2)
    assert c.tolist() == [0, 1] and s.tolist() == [5, 10**15] and e.tolist() == [7, 10**15 + 3]
