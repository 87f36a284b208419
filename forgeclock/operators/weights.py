"""Population weights from separate margins (iterative proportional fitting)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeclock.shared import discard, materialise


class Unsettled(RuntimeError):
    """The margins contradict each other or the sample's empty cells."""


def margin_goals(sessions: DataFrame, column: str, target: DataFrame) -> DataFrame:
    """(value, n, share, goal, fate): what share of all weight each value of ``column`` gets.

    ``target`` is (value, share).  A target that no session has is ``collapsed``: its share goes to the other targets in proportion.
    A value without a target is ``untargeted`` and keeps its share of the sample, so the targets divide what is left.  All others
    are ``met``.  Null is a value like any other; repeated targets add up.
    """
    seen = sessions.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    goal = target.groupBy(F.col("value").alias("__value")).agg(F.sum("share").alias("share")).where("share IS NOT NULL")
    both = seen.join(goal, F.col("value").eqNullSafe(F.col("__value")), "full").select(
        F.when(F.col("n").isNull(), F.col("__value")).otherwise(F.col("value")).alias("value"), "n", "share"
    )
    both = materialise(both, "margin")
    known = F.col("n").isNotNull() & F.col("share").isNotNull()
    sums = both.agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("share").isNull(), F.col("n"))).alias("untargeted"), F.sum(F.when(known, F.col("share"))).alias("share")
    ).first()
    total, kept = float(sums["n"] or 0), float(sums["untargeted"] or 0)
    left = F.try_divide(F.lit(1 - kept / total if total else 0.0) * F.col("share"), F.lit(float(sums["share"] or 0)))
    return both.select(
        "value", "n", "share",
        F.when(known, left).when(F.col("n").isNotNull(), F.col("n") / F.lit(total)).otherwise(F.lit(0.0)).alias("goal"),
        F.when(known, "met").when(F.col("n").isNotNull(), "untargeted").otherwise("collapsed").alias("fate"),
    )


def rake(sessions: DataFrame, targets: dict[str, DataFrame], close: float = 1e-10, most: int = 200) -> DataFrame:
    """(columns of ``targets``, n, weight): a weight per cell of the sample, such that every margin gets its goal and all weights add up to n.

    Only the cells, one row for each combination that occurs, go through the rounds.  A round scales the cells to each margin in
    turn; it ends when no margin is off by more than ``close`` of all weight, and raises ``Unsettled`` after ``most`` rounds.  Joint targets are
    not needed, and interactions stay as the sample has them.  No sessions: no rows.
    """
    columns = list(targets)
    cells = sessions.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.lit(1.0))
    cells = materialise(cells, "cells")
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    goals = {c: materialise(margin_goals(sessions, c, t).where("n IS NOT NULL").select("value", "goal"), f"goal-{c}") for c, t in targets.items()}

    def with_factor(cells: DataFrame, column: str) -> DataFrame:
        now = cells.groupBy(F.col(column).alias("__of")).agg(F.sum(F.col("n") * F.col("weight")).alias("__now"))
        goal = goals[column].withColumnRenamed("value", "__value")
        factor = now.join(goal, F.col("__of").eqNullSafe(F.col("__value"))).select(
            "__of", F.coalesce(F.try_divide(F.col("goal") * total, "__now"), F.lit(0.0)).alias("__factor"), (F.col("goal") * total - F.col("__now")).alias("__off")
        )
        return cells.join(factor, F.col(column).eqNullSafe(F.col("__of")))

    for _ in range(most):
        for column in columns:
            scaled = with_factor(cells, column).select(*columns, "n", (F.col("weight") * F.col("__factor")).alias("weight"))
            before, cells = cells, materialise(scaled, "cells")
            discard(before)
        # The last margin is met exactly; the others tell whether it is settled.
        off = [with_factor(cells, c).agg(F.max(F.abs("__off"))).first()[0] or 0.0 for c in columns[:-1]]
        if max(off, default=0.0) <= close * total:
            return cells
    raise Unsettled(f"margins off by {max(off) / total:.3g} of all weight after {most} rounds")
