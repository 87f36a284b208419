"""Population weights from margins."""

import pytest
from pyspark.sql import functions as F

from forgeclock.operators import weights


def test_margins_are_met(spark):
    rows = [(i % 2 == 0 or i % 5 == 0, ["linux", "macos", None][i % 3 if i % 7 else 0], i % 4) for i in range(300)]
    seen = spark.createDataFrame(rows, "ci boolean, os string, cores int")
    targets = {
        "ci": spark.createDataFrame([(True, 0.3), (False, 0.7)], "value boolean, share double"),
        "os": spark.createDataFrame([("linux", 0.2), ("linux", 0.3), (None, 0.25), ("plan9", 0.25)], "value string, share double"),
    }
    out = weights.rake(seen, targets, close=1e-6).toPandas()
    n = len(rows)
    assert out["n"].sum() == n and abs((out["n"] * out["weight"]).sum() - n) < 1e-3
    macos = sum(r[1] == "macos" for r in rows) / n
    want = {"ci": {True: 0.3, False: 0.7}, "os": {"linux": (1 - macos) * 2 / 3, None: (1 - macos) / 3, "macos": macos}}
    for column, goals in want.items():
        share = (out["n"] * out["weight"]).groupby(out[column], dropna=False).sum() / n
        got = {None if k != k else k: v for k, v in share.items()}
        assert got.keys() == goals.keys() and all(abs(got[k] - g) < 1e-5 for k, g in goals.items()), (column, got)
    fates = {r.value: (r.fate, r.goal) for r in weights.margin_goals(seen, "os", targets["os"]).collect()}
    assert fates["plan9"] == ("collapsed", 0.0) and fates["macos"][0] == "untargeted" and fates[None][0] == "met"
    assert weights.rake(seen.limit(0), targets).count() == 0


def test_contradicting_margins_are_told(spark):
    seen = spark.createDataFrame([(0, 0), (1, 1)], "a int, b int")
    targets = {c: spark.createDataFrame([(0, s), (1, 1 - s)], "value int, share double") for c, s in (("a", 0.2), ("b", 0.6))}
    with pytest.raises(weights.Unsettled, match="margins off"):
        weights.rake(seen.withColumn("x", F.lit(1)), targets, most=2)
