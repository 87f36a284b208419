"""Crossed effects: what a class costs and how fast a machine is, from builds of many classes on many machines."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeclock.operators.connected import connected
from forgeclock.shared import discard, materialise


class CrossedFit(NamedTuple):
    classes: DataFrame
    machines: DataFrame
    slope: float
    rounds: int
    left_out: int


def _dot(x: str, y: str) -> Column:
    return F.coalesce(F.sum(F.col(x) * F.col(y) / F.col("n")), F.lit(0.0))


def crossed_effects(
    observations: DataFrame,
    anchor,
    class_col: str = "class_id",
    machine_col: str = "machine_id",
    tolerance: float = 1e-9,
    max_rounds: int = 200,
) -> CrossedFit:
    """Least-squares fit of log cost = class + machine + slope * load.

    Classes and machines that no chain of common builds connects can't be compared, so effects hold within a ``component``: in the
    component of the machine ``anchor`` that machine is held at 0, in every other one its smallest machine; the column ``anchor``
    names it, and components are named by their smallest machine.  Rows without cost or load tell nothing about the slope and are left out, counted in ``left_out``.  The rest is
    reduced to one cell per class and machine in a single scan.  Class effects are eliminated, and the machines' normal equations
    are solved by conjugate gradients, for cost and for load at once: a round is one pass over the cells, and there are about as many
    as the square root of what alternating means would take.  The slope is that of what is left of cost on what is left of
    load.  A fit that isn't settled after ``max_rounds`` fails.
    """
    c, m = class_col, machine_col
    known = F.col("y").isNotNull() & F.col("load").isNotNull()

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(known, value)).cast("double"), F.lit(0.0))

    y, load = F.col("y"), F.col("load")
    every = materialise(
        observations.groupBy(F.col(c).alias("c"), F.col(m).alias("m")).agg(
            F.count_if(known).cast("double").alias("n"), F.count_if(~known).alias("unknown"),
            total(y).alias("sy"), total(load).alias("sl"), total(y * load).alias("sly"), total(load * load).alias("sll"),
        ),
        "cells",
    )
    left_out = every.agg(F.coalesce(F.sum("unknown"), F.lit(0))).first()[0]
    cells = every.where("n > 0").drop("unknown")
    means = cells.groupBy("c").agg((F.sum("sy") / F.sum("n")).alias("my"), (F.sum("sl") / F.sum("n")).alias("ml"))
    means = materialise(means, "means")
    rest = cells.join(means, "c").groupBy("m").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("sy") - F.col("n") * F.col("my")).alias("ry"), F.sum(F.col("sl") - F.col("n") * F.col("ml")).alias("rl"),
    )
    nothing = F.lit(0.0)
    state = rest.select("m", "n", *(x for k in "yl" for x in (nothing.alias(f"b{k}"), f"r{k}", (F.col(f"r{k}") / F.col("n")).alias(f"p{k}"))))
    first: dict[str, float] = {}
    step = None
    for rounds in range(1, max_rounds + 1):
        before, state = step, materialise(state, "state") if step is None else state
        spread = cells.join(state.select("m", "py", "pl"), "m").groupBy("c").agg(
            *[(F.sum(F.col("n") * F.col(f"p{k}")) / F.sum("n")).alias(f"c{k}") for k in "yl"]
        )
        spread = materialise(spread, "spread")  # so that the cells lie on disk once for each half of a round, not for both
        back = cells.join(spread, "c").groupBy("m").agg(*[F.sum(F.col("n") * F.col(f"c{k}")).alias(f"g{k}") for k in "yl"])
        step = state.join(back, "m").select(
            *state.columns, *[(F.col("n") * F.col(f"p{k}") - F.col(f"g{k}")).alias(f"q{k}") for k in "yl"]
        )
        step = materialise(step, "step")
        discard(spread)
        if before is not None:
            discard(before)
        dots = step.agg(
            *[x for k in "yl" for x in (
                F.coalesce(F.sum(F.col(f"p{k}") * F.col(f"q{k}")), nothing).alias(f"pq{k}"), _dot(f"r{k}", f"r{k}").alias(f"rr{k}"),
                _dot(f"r{k}", f"q{k}").alias(f"rq{k}"), _dot(f"q{k}", f"q{k}").alias(f"qq{k}"),
            )]
        ).first()
        first = first or {k: dots[f"rr{k}"] for k in "yl"}
        news, settled = [F.col("m"), F.col("n")], True
        for k in "yl":
            alpha = dots[f"rr{k}"] / dots[f"pq{k}"] if dots[f"pq{k}"] > 0 else 0.0
            left = max(0.0, dots[f"rr{k}"] - 2 * alpha * dots[f"rq{k}"] + alpha * alpha * dots[f"qq{k}"])
            beta = left / dots[f"rr{k}"] if dots[f"rr{k}"] > 0 else 0.0
            residual = F.col(f"r{k}") - F.lit(alpha) * F.col(f"q{k}")
            news += [
                (F.col(f"b{k}") + F.lit(alpha) * F.col(f"p{k}")).alias(f"b{k}"), residual.alias(f"r{k}"),
                (residual / F.col("n") + F.lit(beta) * F.col(f"p{k}")).alias(f"p{k}"),
            ]
            settled = settled and (left <= tolerance**2 * first[k] or alpha == 0.0)
        state = step.select(*news)
        if settled:
            break
    else:
        raise RuntimeError(f"no fit after {max_rounds} rounds")
    hosts = materialise(state.select("m", "by", "bl"), "hosts")
    own = cells.join(hosts, "m").groupBy("c").agg(
        *[(F.sum(F.col(f"s{k}") - F.col("n") * F.col(f"b{k}")) / F.sum("n")).alias(f"a{k}") for k in "yl"]
    )
    classes = materialise(own, "classes")
    fitted = F.col("al") + F.col("bl")
    both = F.sum(F.col("sly") - fitted * F.col("sy")), F.sum(F.col("sll") - fitted * F.col("sl"))
    slope = cells.join(classes, "c").join(hosts, "m").agg(F.coalesce(F.try_divide(*both), F.lit(0.0))).first()[0]

    # Machines that share a class hang together; one link per class and machine, to the class's first machine, says so.
    chief = materialise(cells.groupBy("c").agg(F.min("m").alias("chief")), "chiefs")
    links = materialise(cells.join(chief, "c").select(F.col("m").alias("a"), F.col("chief").alias("b")).distinct(), "links")
    discard(every, means)
    part = connected(links)
    discard(links)
    class_part = classes.join(chief, "c").join(part.withColumnRenamed("node", "chief"), "chief")
    host_part = hosts.join(part.withColumnRenamed("node", "m"), "m")
    classes = class_part.select("c", "component", (F.col("ay") - F.lit(slope) * F.col("al")).alias("a"))
    hosts = materialise(host_part.select("m", "component", (F.col("by") - F.lit(slope) * F.col("bl")).alias("b")), "hosts")
    held = F.struct((F.col("m") != anchor).alias("other"), "m", "b")
    zero = hosts.groupBy("component").agg(F.min(held).alias("z")).select("component", F.col("z.m").alias("anchor"), F.col("z.b").alias("zero"))
    zero = materialise(zero, "anchors")
    return CrossedFit(
        classes.join(zero, "component").select(F.col("c").alias(c), (F.col("a") + F.col("zero")).alias("intrinsic"), "component", "anchor"),
        hosts.join(zero, "component").select(F.col("m").alias(m), (F.col("b") - F.col("zero")).alias("speed"), "component", "anchor"),
        slope,
        rounds,
        left_out,
    )
