"""Order-dependent operators against plain Python, with segments that really cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgeclock.operators.ordered import exact_quantiles, running_last, running_sum, value_band, with_share


@pytest.mark.parametrize("strict", [False, True])
def test_running_last_across_segments(spark, strict):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "b", None]), i, rng.choice([None, rng.randint(0, 9)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v int")
    got = running_last(df, ["k"], "pos", {"last": F.col("v")}, F.floor(F.col("pos") / 7), strict)
    have = {r.pos: r["last"] for r in got.collect()}
    state, want = {}, {}
    for k, pos, v in rows:
        if strict:
            want[pos] = state.get(k)
        if v is not None:
            state[k] = v
        if not strict:
            want[pos] = state.get(k)
    assert have == want


def test_running_last_keeps_null_inside_struct(spark):
    rows = [("a", 1, 5), ("a", 2, None), ("a", 30, None)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v int")
    mark = {"m": F.when(F.col("pos") < 10, F.struct("v"))}
    got = running_last(df, ["k"], "pos", mark, F.floor(F.col("pos") / 10))
    assert {r.pos: r.m.v for r in got.collect()} == {1: 5, 2: None, 30: None}


def test_running_sum_across_segments(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), t, rng.randint(-3, 3)) for t in range(300)]
    df = spark.createDataFrame(rows, "k string, t bigint, d bigint")
    got = {r.t: r.s for r in running_sum(df, ["k"], "t", "d", "s", F.floor(F.col("t") / 11)).collect()}
    total, want = {"a": 0, "b": 0}, {}
    for k, t, d in rows:
        total[k] += d
        want[t] = total[k]
    assert got == want


def test_bands_rise_with_values(spark):
    values = sorted({s * v for v in [*range(200), *[2**i + d for i in range(8, 60) for d in (-1, 0, 1)]] for s in (1, -1)})
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    bands = [r[0] for r in df.orderBy("x").select(value_band(F.col("x"))).collect()]
    assert bands == sorted(bands)


def test_exact_quantiles_with_a_hot_key(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", int(v)) for v in rng.lognormal(8, 2, 4000)] + [("small", int(v)) for v in rng.integers(-50, 50, 7)]
    rows += [("one", 42), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x bigint")
    probs = {"p10": 0.1, "median": 0.5, "p90": 0.9, "low": 0.0, "high": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "x", probs).collect()}
    assert set(got) == {"hot", "small", "one"}
    for k, row in got.items():
        values = [x for kk, x in rows if kk == k]
        assert row.n == len(values)
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_exact_quantile_without_keys(spark):
    df = spark.range(1, 100_001).withColumnRenamed("id", "x")
    assert exact_quantiles(df, [], "x", {"median": 0.5}).first().median == 50_000.5


def test_share_of_group_and_of_everything(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "x", 4), (None, "z", 2)], "g string, v string, n bigint")
    inside = {(r.g, r.v): r.p for r in with_share(df, "n", "p", ["g"]).collect()}
    assert inside == {("a", "x"): 25.0, ("a", "y"): 75.0, ("b", "x"): 100.0, (None, "z"): 100.0}
    assert {(r.g, r.v): r.p for r in with_share(df, "n", "p", []).collect()}[("b", "x")] == 40.0
