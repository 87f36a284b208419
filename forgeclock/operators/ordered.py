"""Order-dependent operators that stay balanced when one key is hot.

A plain window sorts a whole key group in one task.  Here each key group is cut
into segments of its order column: the window runs inside a segment, one
aggregated row per segment carries the state across the cut, and a left join
puts the carry back.  Groups that fit one segment produce no carry rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _null_safe(left: DataFrame, right: DataFrame, left_cols: list[str], right_cols: list[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left_cols, right_cols):
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def running_last(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: dict[str, Column],
    segment: Column,
    strict: bool = False,
) -> DataFrame:
    """Add, per name, the latest non-null value at or before each row of its key group.

    ``strict`` leaves the row itself out.  ``segment`` must not fall as ``order`` rises.
    """
    tmp = {f"__v_{n}": c for n, c in values.items()}
    base = df.withColumns({**tmp, "__seg": segment})
    inside = (
        Window.partitionBy(*keys, "__seg")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    )
    local = base.withColumns(
        {n: F.last(f"__v_{n}", ignorenulls=True).over(inside) for n in values}
    ).drop(*tmp)

    heads = base.groupBy(*keys, "__seg").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in tmp]
    )
    before = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = heads.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__seg").alias("__cseg"),
        *[F.last(v, ignorenulls=True).over(before).alias(f"__c{v}") for v in tmp],
    ).where(" OR ".join(f"`__c{v}` IS NOT NULL" for v in tmp))

    cond = _null_safe(local, carry, [*keys, "__seg"], [*[f"__k_{k}" for k in keys], "__cseg"])
    joined = local.join(carry, cond, "left")
    return joined.withColumns(
        {n: F.coalesce(F.col(n), F.col(f"__c__v_{n}")) for n in values}
    ).drop("__seg", "__cseg", *[f"__k_{k}" for k in keys], *[f"__c{v}" for v in tmp])


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: str, name: str, segment: Column
) -> DataFrame:
    """Add the sum of ``value`` over all rows at or before each row of its key group.

    Rows with equal ``order`` must have been merged by the caller.
    """
    base = df.withColumn("__seg", segment)
    inside = (
        Window.partitionBy(*keys, "__seg")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = base.withColumn(name, F.sum(value).over(inside))
    before = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        base.groupBy(*keys, "__seg")
        .agg(F.sum(value).alias("__t"))
        .select(
            *[F.col(k).alias(f"__k_{k}") for k in keys],
            F.col("__seg").alias("__cseg"),
            F.sum("__t").over(before).alias("__carry"),
        )
        .where(F.col("__carry").isNotNull())
    )
    cond = _null_safe(local, carry, [*keys, "__seg"], [*[f"__k_{k}" for k in keys], "__cseg"])
    return (
        local.join(carry, cond, "left")
        .withColumn(name, F.col(name) + F.coalesce("__carry", F.lit(0)))
        .drop("__seg", "__cseg", "__carry", *[f"__k_{k}" for k in keys])
    )


def value_band(value: Column) -> Column:
    """Monotone integer band of a BIGINT: bit length plus the next five bits."""
    size = F.length(F.bin(F.abs(value)))
    shift = F.greatest(size - 6, F.lit(0))
    return F.signum(value).cast("bigint") * (
        size.cast("bigint") * 64 + F.call_function("shiftright", F.abs(value), shift)
    )


def _within_band(value: Column) -> Column:
    """Monotone inside a band: the next ten bits, so a band is sorted in up to 1024 pieces."""
    shift = F.greatest(F.length(F.bin(F.abs(value))) - 16, F.lit(0))
    return F.signum(value).cast("bigint") * F.call_function("shiftright", F.abs(value), shift)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact interpolated quantiles of a BIGINT column per key, plus the row count ``n``.

    Equal values are merged first, a banded histogram locates the wanted ranks, and
    only the bands that hold a rank are sorted, in pieces, so a hot key is never gathered whole.
    ``weight`` says how many rows a row stands for.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__x"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
        .withColumn("__band", value_band(F.col("__x")))
    )
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("__band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bands = (
        counts.groupBy(*keys, "__band")
        .agg(F.sum("__n").alias("__bn"))
        .withColumns({
            "__before": F.sum("__bn").over(upto) - F.col("__bn"),
            "n": F.sum("__bn").over(by_key),
        })
    )
    ranks = {}
    for name, p in probs.items():
        ranks[f"__lo_{name}"] = F.floor(F.lit(p) * (F.col("n") - 1)).cast("bigint")
        ranks[f"__hi_{name}"] = F.ceil(F.lit(p) * (F.col("n") - 1)).cast("bigint")
    wanted = F.lit(False)
    for r in ranks.values():
        wanted = wanted | ((r >= F.col("__before")) & (r < F.col("__before") + F.col("__bn")))
    hit = bands.where(wanted).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__band").alias("__hb"), "__before", "n"
    )
    cond = _null_safe(counts, hit, [*keys, "__band"], [*[f"__k_{k}" for k in keys], "__hb"])
    inside = counts.join(hit, cond).drop(*[f"__k_{k}" for k in keys], "__hb")
    summed = running_sum(inside, [*keys, "__band"], "__x", "__n", "__end", _within_band(F.col("__x")))
    placed = (
        summed.withColumn("__end", F.col("__end") + F.col("__before"))
        .withColumn("__start", F.col("__end") - F.col("__n"))
        .withColumns(ranks)
    )
    picks = [
        F.max(F.when((F.col(r) >= F.col("__start")) & (F.col(r) < F.col("__end")), F.col("__x"))).alias(r)
        for r in ranks
    ]
    picked = placed.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    out = []
    for name, p in probs.items():
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        frac = F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
        out.append((lo + (hi - lo) * frac).cast("double").alias(name))
    return picked.select(*keys, "n", *out)


def with_share(df: DataFrame, amount: str, name: str, within: list[str], digits: int = 1) -> DataFrame:
    """Add the percentage of ``amount`` in its ``within`` group, rounded.

    Totals come from a partial aggregation, so the detail rows of a large group are
    never gathered in one task; the grand total is a scalar subquery.
    """
    if within:
        totals = df.groupBy(*[F.col(k).alias(f"__t_{k}") for k in within]).agg(F.sum(amount).alias("__total"))
        cond = _null_safe(df, totals, within, [f"__t_{k}" for k in within])
        joined = df.join(totals, cond)
        total = F.col("__total")
    else:
        joined = df
        total = df.agg(F.sum(amount).alias("__total")).scalar()
    share = F.round(F.lit(100.0) * F.col(amount) / F.nullif(total, F.lit(0)), digits)
    return joined.withColumn(name, share).drop("__total", *[f"__t_{k}" for k in within])
