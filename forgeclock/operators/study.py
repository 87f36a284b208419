"""Study tables and models on top of the published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeclock.functions import ids
from forgeclock.operators.ordered import exact_quantiles, running_sum, with_share
from forgeclock.shared import materialise

MICROS = 1_000_000

# ------------------------------------------------------------------ keys shared by units and phases


def unit_key(package_id: Column, crate: Column) -> Column:
    """Package key as the sampler spells it: name-version, or the crate for workspace units."""
    local = F.startswith(package_id, F.lit("workspace")) | F.startswith(package_id, F.lit("path+"))
    named = F.concat(ids.package_name(package_id), F.lit("-"), ids.package_version(package_id))
    return F.when(local, F.translate(crate, "-", "_")).otherwise(named)


def with_unit_key(units: DataFrame) -> DataFrame:
    """Units with package and crate spelled as in the phases table."""
    return units.withColumns({
        "package": unit_key(F.col("package_id"), F.col("crate")),
        "crate": F.translate("crate", "-", "_"),
    })


def units_by_key(units: DataFrame) -> DataFrame:
    """Units reduced to (run_id, package, crate) as the phases table spells them."""
    return with_unit_key(units).groupBy("run_id", "package", "crate").agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("duration").alias("duration"),
        F.sum("frontend").alias("frontend"),
        F.sum("codegen").alias("codegen"),
        F.sum("link").alias("link"),
    )


def phases_by_key(phases: DataFrame) -> DataFrame:
    """Phases reduced to (run_id, package, crate); serial and parallel stay apart."""
    serial, parallel = F.col("thread") == "serial", F.col("thread") == "parallel"
    samples = F.col("samples")
    return phases.groupBy("run_id", "package", "crate").agg(
        F.sum(F.when(serial, samples)).alias("serial"),
        F.sum(F.when(parallel, samples)).alias("parallel"),
        F.sum(F.when(parallel & (F.col("phase") == "codegen"), samples)).alias("parallel_codegen"),
        F.sum(F.when(F.col("phase") == "blocked", samples)).alias("blocked"),
        F.max("wall_s").alias("wall_s"),
        F.max("rate_hz").alias("rate_hz"),
    )


def reconciled(units: DataFrame, phases: DataFrame) -> DataFrame:
    """Units and their sampled phases, joined on the reconciled key."""
    return units_by_key(units).join(phases_by_key(phases), ["run_id", "package", "crate"])


def conservation(units: DataFrame, phases: DataFrame, tolerance: float) -> DataFrame:
    """Whether serial sampled seconds stay within ``tolerance`` of a unit's wall."""
    both = reconciled(units, phases)
    sampled = F.try_divide(F.coalesce("serial", F.lit(0)), F.col("rate_hz"))
    off = F.abs(sampled - F.col("duration"))
    return both.select(
        "run_id", "package", "crate", "duration", sampled.alias("sampled_s"),
        (off <= tolerance * F.col("duration")).alias("conserved"),
    )


def codegen_parallelism(units: DataFrame, phases: DataFrame) -> DataFrame:
    """CPU seconds on codegen threads per wall second of codegen."""
    both = reconciled(units, phases)
    cpu = F.try_divide(F.col("parallel_codegen"), F.col("rate_hz"))
    return both.where("codegen > 0").select(
        "run_id", "package", "crate", (cpu / F.col("codegen")).alias("parallelism")
    )


def wall_difference(units: DataFrame, phases: DataFrame) -> DataFrame:
    """Distribution per package of event-log wall minus sampler wall, in microseconds."""
    diff = F.round((F.col("duration") - F.col("wall_s")) * MICROS).cast("bigint")
    both = reconciled(units, phases).select("package", diff.alias("diff_us"))
    return exact_quantiles(both, ["package"], "diff_us", {"p10": 0.1, "median": 0.5, "p90": 0.9})


def blocked_share(phases: DataFrame) -> DataFrame:
    """Blocked samples over all samples per unit."""
    unit = ["run_id", "package", "crate", "crate_type"]
    blocked = F.sum(F.when(F.col("phase") == "blocked", F.col("samples")).otherwise(F.lit(0)))
    return phases.groupBy(*unit).agg(F.try_divide(blocked, F.sum("samples")).alias("blocked_share"))


def sample_seconds(phases: DataFrame) -> DataFrame:
    return phases.withColumn("seconds", F.try_divide(F.col("samples"), F.col("rate_hz")))


# ------------------------------------------------------------------ provenance and cache events


def capture_tags(units: DataFrame, unit_flags: DataFrame, phases: DataFrame, wrapped: DataFrame) -> DataFrame:
    """Units by key with ``capture`` (clean, cached, incremental), ``source`` and ``trust``.

    A unit without samples in a sampled build that uses a compiler wrapper is a cache
    event: it keeps no timing.  ``wrapped`` holds the run ids with a wrapper.
    """
    key = ["run_id", "package", "crate"]
    incremental = (
        unit_flags.where("flag = 'incremental' AND value = 'true'").select("run_id").distinct().withColumn("inc", F.lit(True))
    )
    sampled = phases.select(*key).distinct().withColumn("sampled", F.lit(True))
    wrapper = wrapped.select("run_id").distinct().withColumn("wrapper", F.lit(True))
    tagged = (
        units_by_key(units)
        .join(sampled, key, "left")
        .join(incremental, "run_id", "left")
        .join(wrapper, "run_id", "left")
    )
    cached = F.col("wrapper").isNotNull() & F.col("sampled").isNull()
    capture = F.when(cached, F.lit("cached")).when(F.col("inc").isNotNull(), F.lit("incremental")).otherwise(F.lit("clean"))
    return tagged.select(
        *key,
        capture.alias("capture"),
        F.when(~cached, F.col("duration")).alias("duration"),
        F.lit("contributed").alias("source"),
        F.when(cached, F.lit("event")).otherwise(F.lit("unverified")).alias("trust"),
    )


def cache_events(units: DataFrame, phases: DataFrame, wrapped: DataFrame) -> DataFrame:
    """Units of wrapped builds that left no samples; no timing is claimed."""
    key = ["run_id", "package", "crate"]
    return (
        units_by_key(units)
        .join(wrapped.select("run_id").distinct(), "run_id", "left_semi")
        .join(phases.select(*key), key, "left_anti")
        .select(*key, "units")
    )


def partial_sessions(sessions: DataFrame) -> DataFrame:
    part = (F.coalesce("units_withheld", F.lit(0)) > 0) | ~F.coalesce("complete", F.lit(False))
    return sessions.select("run_id", part.alias("partial"))


# ------------------------------------------------------------------ study tables


def machines(sessions: DataFrame) -> DataFrame:
    """One row per machine: its newest profile and how many builds it sent."""
    profile = ["os", "arch", "cpu_model", "cpu_cores", "mem_gb"]
    newest = F.max(F.struct("timestamp", "run_id", *profile)).alias("last")
    return (
        sessions.where(F.col("machine_id").isNotNull())
        .groupBy("machine_id")
        .agg(newest, F.count(F.lit(1)).alias("builds"))
        .select("machine_id", "builds", F.col("last.timestamp").alias("last_seen"), *[F.col(f"last.{c}").alias(c) for c in profile])
    )


def environments(sessions: DataFrame) -> DataFrame:
    """One row per toolchain, client and profile."""
    return sessions.groupBy("rustc_version", "client", "profile").agg(
        F.count(F.lit(1)).alias("builds"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


def projects(units: DataFrame) -> DataFrame:
    """One row per build: unit count, summed parts and the whole envelope."""
    script = F.col("mode") == "run-custom-build"
    return units.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("units"),
        F.sum(F.when(~script, F.col("duration"))).alias("compile"),
        F.sum(F.when(script, F.col("duration"))).alias("build_scripts"),
        F.sum("link").alias("link"),
        (F.max("finished") - F.min("started")).alias("envelope"),
    )


def decomposition(units: DataFrame, script_mode: str = "run-custom-build") -> DataFrame:
    """Total = intrinsic + link + build scripts; what is left of the envelope is the residual.

    Link time is part of a unit's duration, so the intrinsic part leaves it out.
    """
    script = F.col("mode") == script_mode
    link = F.coalesce("link", F.lit(0.0))
    parts = units.groupBy("run_id").agg(
        F.sum(F.when(script, F.lit(0.0)).otherwise(F.col("duration") - link)).alias("intrinsic"),
        F.sum(F.when(script, F.lit(0.0)).otherwise(link)).alias("link"),
        F.sum(F.when(script, F.col("duration")).otherwise(F.lit(0.0))).alias("build_scripts"),
        (F.max("finished") - F.min("started")).alias("envelope"),
    )
    total = F.col("intrinsic") + F.col("link") + F.col("build_scripts")
    return parts.withColumn("total", total).withColumn("residual", F.col("envelope") - F.col("total"))


def measurements(units: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per unit observation with its capture context; replicates stay rows."""
    context = sessions.select("run_id", "timestamp", "machine_id", "rustc_version", "client", "loadavg_mean")
    return units.select(
        "run_id", unit_key(F.col("package_id"), F.col("crate")).alias("class"), F.col("duration").alias("wall_s"), "mode"
    ).join(context, "run_id", "left")


def cone_totals(cones: DataFrame, costs: DataFrame) -> DataFrame:
    """Cost of every class's cone from (src, dst) pairs and (class_id, cost)."""
    per_class = costs.groupBy(F.col("class_id").alias("dst")).agg(
        F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n")
    )
    return cones.join(per_class, "dst").groupBy("src").agg(F.sum("cost").alias("cost"), F.sum("n").alias("n"))


# ------------------------------------------------------------------ statistics


def robust_stats(observations: DataFrame, keys: list[str], cost: str, machine: str) -> DataFrame:
    """Median, median absolute deviation, p10, p90, rows and machines per key; exact.

    Observations are read once and reduced to counts per key, cost and machine; everything else reads the counts.
    """
    counted = materialise(observations.groupBy(*keys, cost, machine).agg(F.count(F.lit(1)).alias("__w")), "counted")
    spread = exact_quantiles(counted, keys, cost, {"median": 0.5, "p10": 0.1, "p90": 0.9}, weight="__w")
    spread = materialise(spread, "spread")
    twice = counted.join(spread.select(*keys, "median"), keys).withColumn(
        "__dev2", F.abs(F.col(cost) * 2 - F.round(F.col("median") * 2).cast("bigint"))
    )
    mad = exact_quantiles(twice, keys, "__dev2", {"mad2": 0.5}, weight="__w").select(*keys, (F.col("mad2") / 2).alias("mad"))
    hosts = counted.groupBy(*keys).agg(F.count_distinct(machine).alias("machines"))
    return spread.join(mad, keys).join(hosts, keys)


def toolchain_ratio(observations: DataFrame, old: str, new: str) -> DataFrame:
    """Per class, median cost under two toolchains and their ratio."""
    both = observations.where(F.col("toolchain").isin(old, new))
    med = exact_quantiles(both, ["class_id", "toolchain"], "cost_us", {"median": 0.5})
    sides = med.groupBy("class_id").agg(
        F.max(F.when(F.col("toolchain") == old, F.col("median"))).alias("old_median"),
        F.max(F.when(F.col("toolchain") == new, F.col("median"))).alias("new_median"),
    )
    ratio = F.try_divide("new_median", "old_median")
    return sides.where("old_median IS NOT NULL AND new_median IS NOT NULL").withColumn("ratio", ratio)


def version_steps(observations: DataFrame) -> DataFrame:
    """Same machine and package, consecutive versions: median cost and change."""
    med = exact_quantiles(observations, ["machine_id", "package", "version"], "cost_us", {"median": 0.5})
    # One row per version is left, so the ordered group is the package's release list.
    order = Window.partitionBy("machine_id", "package").orderBy(ids.precedence_key(F.col("version")), "version")
    return med.select(
        "machine_id",
        "package",
        "version",
        "median",
        F.lag("version").over(order).alias("previous"),
        F.try_divide(F.col("median"), F.lag("median").over(order)).alias("ratio"),
    )


def candle_calibration(readings: DataFrame, stale_before: str) -> DataFrame:
    """Machine speed from the newest reading of the reference project.

    ``readings`` is (machine_id, observed_at, cost_us).  Speed is the fleet median
    over the machine's cost; readings from before ``stale_before`` weigh half.
    """
    newest = readings.groupBy("machine_id").agg(F.max(F.struct("observed_at", "cost_us")).alias("last")).select(
        "machine_id", "last.observed_at", "last.cost_us"
    )
    fleet = exact_quantiles(newest, [], "cost_us", {"median": 0.5}).select("median").scalar()
    return newest.select(
        "machine_id",
        "observed_at",
        F.try_divide(fleet, F.col("cost_us")).alias("speed"),
        F.when(F.col("observed_at") >= stale_before, F.lit(1.0)).otherwise(F.lit(0.5)).alias("weight"),
    )


def contention_weight(load: Column, cores: Column) -> Column:
    """1 on an idle machine, falling with load per core; unknown load stays unknown."""
    return F.try_divide(F.lit(1.0), F.lit(1.0) + F.try_divide(load, cores))


def noise_floor(observations: DataFrame, keys: list[str], y: str) -> DataFrame:
    """Spread of repeated builds per key; single builds say nothing and are left out."""
    return (
        observations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(y).alias("spread")).where("n > 1")
    )


def post_stratify(sessions: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Weight per stratum that moves the sample to the target mix (keys, share).

    Weights are target share over observed share.
    """
    seen = sessions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = seen.agg(F.sum("n")).scalar()
    goal = target.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("share"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & seen[k].eqNullSafe(goal[f"__{k}"])
    return seen.join(goal, cond).select(*keys, "n", (F.col("share") * total / F.col("n")).alias("weight"))


# ------------------------------------------------------------------ builds over time


def envelopes(units: DataFrame) -> DataFrame:
    """Whole-build wall against the sum of its units."""
    return units.groupBy("run_id").agg(
        (F.max("finished") - F.min("started")).alias("envelope"), F.sum("duration").alias("unit_seconds")
    ).withColumn("overlap", F.try_divide("unit_seconds", "envelope"))


def concurrency(units: DataFrame, bucket: float) -> DataFrame:
    """Units running over time per build, from their intervals (a sweep line).

    ``bucket`` is the stretch of build time that shares a window task.
    """
    whole = units.where("started IS NOT NULL AND finished IS NOT NULL")
    edges = whole.select(
        "run_id",
        F.inline(
            F.array(
                F.struct(F.col("started").alias("t"), F.lit(1).cast("bigint").alias("d")),
                F.struct(F.col("finished").alias("t"), F.lit(-1).cast("bigint").alias("d")),
            )
        ),
    )
    merged = edges.groupBy("run_id", "t").agg(F.sum("d").alias("d"))
    out = running_sum(merged, ["run_id"], "t", "d", "active", F.floor(F.col("t") / bucket))
    return out.select("run_id", "t", "active")


def bound_by(timeline: DataFrame, bucket: float, waiting_limit: float = 0.5, cpu_limit: float = 50.0) -> DataFrame:
    """Per build, whether it waited for dependencies or for the processor.

    The two series tick on different clocks, so both are averaged per time bucket
    and the buckets that have both are compared.
    """
    slot = F.floor(F.col("t") / bucket)
    slots = timeline.groupBy("run_id", slot.alias("slot")).agg(
        F.avg("waiting").alias("waiting"), F.avg("active").alias("active"), F.avg("cpu_pct").alias("cpu")
    )
    both = slots.where("waiting IS NOT NULL AND cpu IS NOT NULL")
    share = F.try_divide(F.col("waiting"), F.col("waiting") + F.col("active"))
    per_run = both.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("slots"),
        F.count_if((share > waiting_limit) & (F.col("cpu") < cpu_limit)).alias("starved"),
        F.count_if(F.col("cpu") >= cpu_limit).alias("busy"),
    )
    verdict = (
        F.when(F.col("starved") * 2 > F.col("slots"), F.lit("dependency-bound"))
        .when(F.col("busy") * 2 > F.col("slots"), F.lit("cpu-bound"))
        .otherwise(F.lit("mixed"))
    )
    return per_run.withColumn("verdict", verdict)


# ------------------------------------------------------------------ environment census

# Settings whose use the census reports.
CENSUS_FLAGS = ("opt-level", "debuginfo", "codegen-units", "lto")


def settings_distribution(unit_flags: DataFrame) -> DataFrame:
    counted = unit_flags.where(F.col("flag").isin(*CENSUS_FLAGS)).groupBy("flag", "value").agg(
        F.count(F.lit(1)).alias("units")
    )
    return with_share(counted, "units", "share_pct", ["flag"])


def census(sessions: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """Builds and their share, grouped ``by`` and relative to ``within``."""
    counted = sessions.groupBy(*by).agg(F.count(F.lit(1)).alias("builds"))
    return with_share(counted, "builds", "share_pct", within)


def settings_columns(unit_flags: DataFrame, wanted: tuple[str, ...] = CENSUS_FLAGS) -> DataFrame:
    """Chosen settings as columns, one row per unit."""
    unit = ["run_id", "package", "crate", "crate_type"]
    return unit_flags.groupBy(*unit).agg(
        *[F.max(F.when(F.col("flag") == f, F.col("value"))).alias(f.replace("-", "_")) for f in wanted]
    )


def ci_and_local(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Builds per key in CI, on local machines, and unknown."""
    return sessions.groupBy(*keys).agg(
        F.count_if("ci").alias("ci"), F.count_if(~F.col("ci")).alias("local"), F.count_if(F.col("ci").isNull()).alias("unknown")
    )


def jobs_per_core(sessions: DataFrame) -> DataFrame:
    """Quartiles of jobs per core (in thousandths) and mean load, CI and local apart."""
    s = sessions.withColumn("permille", F.floor(F.try_divide(F.col("jobs") * 1000, F.col("cpu_cores"))).cast("bigint"))
    spread = exact_quantiles(s, ["ci"], "permille", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    load = s.groupBy(F.col("ci").alias("__ci")).agg(F.avg(F.try_divide(F.col("loadavg_mean"), F.col("cpu_cores"))).alias("load_per_core"))
    return spread.join(load, spread.ci.eqNullSafe(load["__ci"])).drop("__ci")


def wrapper_use(sessions: DataFrame, wrapped: Column, units: DataFrame, phases: DataFrame) -> DataFrame:
    """Wrapper adoption and cache hit rate, CI and local apart.

    A hit is a unit of a wrapped build without samples, a miss one with samples.
    """
    key = ["run_id", "package", "crate"]
    sampled = phases.select(*key).distinct().withColumn("sampled", F.lit(1))
    looked = (
        units_by_key(units)
        .join(sampled, key, "left")
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("looked_up"), F.count_if(F.col("sampled").isNull()).alias("hits"))
    )
    joined = sessions.select("run_id", "ci", wrapped.alias("wrapped")).join(looked, "run_id", "left")
    use = joined.groupBy("ci").agg(
        F.count(F.lit(1)).alias("builds"),
        F.count_if("wrapped").alias("wrapped"),
        F.sum(F.when(F.col("wrapped"), F.col("hits"))).alias("hits"),
        F.sum(F.when(F.col("wrapped"), F.col("looked_up"))).alias("looked_up"),
    )
    return use.withColumns({
        "adoption_pct": F.round(F.lit(100.0) * F.col("wrapped") / F.col("builds"), 1),
        "hit_rate": F.try_divide("hits", "looked_up"),
    })


def artifact_response(per_crate: DataFrame, units: DataFrame, folder: str) -> DataFrame:
    """Correlation of artifact bytes with the work that makes them, over crates."""
    work = units.groupBy(folder, F.translate("crate", "-", "_").alias("crate")).agg(
        F.sum("frontend").alias("frontend"), F.sum("codegen").alias("codegen")
    )
    return per_crate.join(work, [folder, "crate"]).agg(
        F.count(F.lit(1)).alias("crates"),
        F.corr("rmeta", "frontend").alias("rmeta_frontend"),
        F.corr("obj", "codegen").alias("obj_codegen"),
    )


def by_era(units: DataFrame, sessions: DataFrame):
    """Units grouped by toolchain and client version, ready to aggregate."""
    return units.join(sessions, "run_id").groupBy("rustc_version", "client")


def link_steps(units: DataFrame, linkers: DataFrame) -> DataFrame:
    """Link wall per linker and package."""
    return (
        units.join(linkers.select("run_id", "linker"), "run_id")
        .groupBy("linker", "package")
        .agg(F.count("link").alias("links"), F.sum("link").alias("link"))
    )
