"""Profiler samples attributed to units, thread classes and compiler phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeclock.functions import coerce, flags, symbols
from forgeclock.operators.ordered import running_last
from forgeclock.shared import materialise

THREAD = ["profile_id", "thread_pos"]
UNIT = ["profile_id", "crate", "crate_type", "unit_hash", "package", "flags"]

# Address range that shares a window task when symbols are looked up.
ADDRESS_SEGMENT = 1 << 20


# ------------------------------------------------------------------ saved profiles to tables


def _threads(profiles: DataFrame) -> DataFrame:
    """One row per thread; stays VARIANT inside."""
    v = F.col("v")
    return profiles.select(
        "profile_id",
        F.transform(coerce.items(v, "$.libs"), lambda x: F.coalesce(coerce.text(x, "$.codeId"), F.lit(""))).alias("libs"),
        F.posexplode(coerce.items(v, "$.threads")).alias("thread_pos", "t"),
    )


def thread_table(profiles: DataFrame) -> DataFrame:
    t = F.col("t")
    return _threads(profiles).select(
        *THREAD,
        coerce.text(t, "$.processName").alias("process_name"),
        coerce.text(t, "$.name").alias("name"),
        F.try_variant_get(t, "$.processStartupTime", "double").alias("startup_ms"),
        F.try_variant_get(t, "$.processShutdownTime", "double").alias("shutdown_ms"),
    )


def node_table(profiles: DataFrame) -> DataFrame:
    """Stack nodes with the address and library of their frame."""
    t = F.col("t")
    longs = {
        "address": "$.frameTable.address",
        "func": "$.frameTable.func",
        "resource": "$.funcTable.resource",
        "owner": "$.resourceTable.lib",
        "frame": "$.stackTable.frame",
        "prefix": "$.stackTable.prefix",
    }
    cut = _threads(profiles).select(
        *THREAD, "libs", *[F.try_variant_get(t, path, "array<bigint>").alias(n) for n, path in longs.items()]
    )
    nodes = cut.select(
        *THREAD, "libs", "address", "func", "resource", "owner",
        F.posexplode(F.arrays_zip("frame", "prefix")).alias("node", "s"),
    )

    def at(array, i):
        return F.get(array, i.cast("int"))

    frame = F.coalesce(F.col("s.frame"), F.lit(0))
    lib = at("owner", at("resource", at("func", frame)))
    return nodes.select(
        *THREAD,
        F.col("node").cast("int").alias("node"),
        F.col("s.prefix").cast("int").alias("prefix"),
        at("address", frame).alias("addr"),
        at("libs", lib).alias("lib"),
    )


def sample_table(profiles: DataFrame) -> DataFrame:
    stacks = F.try_variant_get("t", "$.samples.stack", "array<bigint>")
    return _threads(profiles).select(*THREAD, F.posexplode(stacks).alias("sample_pos", "s")).select(
        *THREAD, "sample_pos", F.col("s").cast("int").alias("stack")
    )


def symbol_table(sidecars: DataFrame) -> DataFrame:
    """(lib, rva, symbol): each library under its code id and its undashed debug id."""
    v = F.col("v")
    libs = sidecars.select(
        F.transform(coerce.items(v, "$.string_table"), lambda x: F.coalesce(coerce.text(x), F.lit(""))).alias("names"),
        F.explode(coerce.items(v, "$.data")).alias("d"),
    )
    d = F.col("d")
    named = F.filter(
        F.array(
            coerce.text(d, "$.code_id"),
            F.upper(F.replace(coerce.text(d, "$.debug_id"), F.lit("-"), F.lit(""))),
        ),
        lambda x: x.isNotNull(),
    )
    rows = F.try_variant_get(d, "$.symbol_table", "array<struct<rva:bigint,symbol:bigint>>")
    return (
        libs.select("names", named.alias("ids"), F.explode(rows).alias("s"))
        .where("s.rva IS NOT NULL AND s.symbol IS NOT NULL")
        .select(
            F.explode("ids").alias("lib"),
            F.col("s.rva").alias("rva"),
            F.coalesce(F.get("names", F.col("s.symbol").cast("int")), F.lit("")).alias("symbol"),
        )
    )


# ------------------------------------------------------------------ symbols and phases of nodes


def resolve_symbols(probes: DataFrame, table: DataFrame) -> DataFrame:
    """(lib, addr, symbol) per distinct probe: the symbol with the greatest rva <= addr.

    An as-of join by union: symbols and probes of a library share one address order
    and the running last symbol answers each probe.
    """
    known = table.groupBy("lib", "rva").agg(F.max("symbol").alias("symbol")).select(
        "lib", F.col("rva").alias("addr"), "symbol", (F.col("rva") * 2).alias("at")
    )
    asked = probes.where("lib IS NOT NULL AND addr IS NOT NULL").select("lib", "addr").distinct().select(
        "lib", "addr", F.lit(None).cast("string").alias("symbol"), (F.col("addr") * 2 + 1).alias("at")
    )
    both = known.unionByName(asked)
    found = running_last(
        both, ["lib"], "at", {"resolved": F.col("symbol")}, F.floor(F.col("addr") / ADDRESS_SEGMENT)
    )
    return found.where(F.pmod("at", F.lit(2)) == 1).select("lib", "addr", F.col("resolved").alias("symbol"))


def named_nodes(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """Stack nodes with their resolved symbol, null where there is none."""
    return nodes.join(resolve_symbols(nodes, table), ["lib", "addr"], "left")


def path_facts(nodes: DataFrame) -> DataFrame:
    """Per node, facts of the whole path from it to the root.

    ``phase``: the marker nearest the root.  ``parked``: whether the first resolved
    frame from the leaf is a wait symbol.  ``traits``: whether the path enters the
    trait solver.  Solved once per node by pointer doubling: every round joins a node
    to the ancestor it has reached and doubles the distance, so a tree of depth d
    takes log2(d) rounds.  Finished nodes leave the loop.
    """
    s = F.col("symbol")
    facts = nodes.select(
        *THREAD,
        "node",
        F.col("prefix").alias("up"),
        symbols.phase_marker(s).alias("phase"),
        symbols.is_wait(s).alias("parked"),
        symbols.is_trait_work(s).alias("traits"),
    )
    state = materialise(facts, "path-facts")
    done = state.where("up IS NULL")
    active = state.where("up IS NOT NULL")
    while not active.isEmpty():
        reached = done.unionByName(active).select(
            *THREAD,
            F.col("node").alias("up"),
            F.col("up").alias("up2"),
            F.col("phase").alias("phase2"),
            F.col("parked").alias("parked2"),
            F.col("traits").alias("traits2"),
        )
        joined = active.join(reached, [*THREAD, "up"], "left").select(
            *THREAD,
            "node",
            F.col("up2").alias("up"),
            F.coalesce("phase2", "phase").alias("phase"),
            F.coalesce("parked", "parked2").alias("parked"),
            (F.col("traits") | F.coalesce("traits2", F.lit(False))).alias("traits"),
        )
        step = materialise(joined, "path-facts")
        done = done.unionByName(step.where("up IS NULL"))
        active = step.where("up IS NOT NULL")
    return done.drop("up")


def sample_phase() -> Column:
    """Phase of a sample from the facts of its node; parked wins over any marker."""
    return F.when(F.coalesce("parked", F.lit(False)), F.lit("blocked")).otherwise(
        F.coalesce("phase", F.lit("unattributed"))
    )


# ------------------------------------------------------------------ units and counts


def unit_threads(threads: DataFrame) -> DataFrame:
    """Threads of compile processes with their unit identity and thread class."""
    rustc = threads.where(F.startswith("process_name", F.lit("rustc")))
    return (
        rustc.select(
            *THREAD,
            "name",
            "startup_ms",
            "shutdown_ms",
            symbols.thread_class(F.col("name")).alias("thread"),
            F.inline(flags.compile_facts(F.col("process_name"))),
        )
        .where("is_compile")
        .withColumn("flags", F.to_json("settings"))
        .drop("is_compile", "settings")
    )


def unit_walls(units: DataFrame) -> DataFrame:
    """Wall seconds per unit from its first thread with a positive span; else null."""
    span = F.col("shutdown_ms") - F.col("startup_ms")
    seconds = F.round(span / 1000 * 1e6) / 1e6
    return units.groupBy(*UNIT).agg(
        F.min_by(seconds, F.when(span > 0, F.col("thread_pos"))).alias("wall_s")
    )


def node_counts(samples: DataFrame) -> DataFrame:
    """Samples per stack node; samples without a stack are skipped."""
    return samples.where("stack IS NOT NULL").groupBy(*THREAD, F.col("stack").alias("node")).agg(
        F.count(F.lit(1)).alias("samples")
    )


def attributed(samples: DataFrame, facts: DataFrame, units: DataFrame) -> DataFrame:
    """Counted nodes with the facts of their path and the unit of their thread."""
    return node_counts(samples).join(facts, [*THREAD, "node"]).join(units, THREAD)


def phase_counts(hits: DataFrame) -> DataFrame:
    """Samples per unit, thread class and phase."""
    return hits.groupBy(*UNIT, "thread", sample_phase().alias("phase")).agg(F.sum("samples").alias("samples"))


def unit_totals(counts: DataFrame) -> DataFrame:
    """Units with at least one sample, largest first."""
    return (
        counts.groupBy(*UNIT)
        .agg(F.sum("samples").alias("samples"))
        .where("samples > 0")
        .orderBy(F.desc("samples"), *UNIT)
    )


def phases_documents(counts: DataFrame, walls: DataFrame, rate_hz: int, sampler: str) -> DataFrame:
    """One JSON text per unit: its settings and two phase maps."""
    entry = F.struct(F.col("phase"), F.col("samples"))
    maps = counts.groupBy(*UNIT).agg(
        *[
            F.map_from_entries(
                F.array_sort(F.collect_list(F.when(F.col("thread") == side, entry)))
            ).alias(side)
            for side in ("serial", "parallel")
        ]
    )
    return maps.join(walls, UNIT).select(
        "profile_id",
        F.lit(sampler).alias("sampler"),
        F.lit(rate_hz).cast("bigint").alias("rate_hz"),
        F.to_json(
            F.struct(
                "crate", "package", "crate_type", F.from_json("flags", "map<string,string>").alias("flags"),
                "wall_s", "serial", "parallel",
            )
        ).alias("unit"),
    )


def codegen_units(hits: DataFrame) -> DataFrame:
    """Samples per codegen-unit thread of each unit."""
    named = F.lit(False)
    for prefix in symbols.CODEGEN_THREAD_PREFIXES:
        named = named | F.startswith("name", F.lit(prefix))
    return hits.where(named).groupBy(*UNIT, F.col("name").alias("codegen_unit")).agg(F.sum("samples").alias("samples"))


def codegen_unit_counts(hits: DataFrame) -> DataFrame:
    """How many codegen units each unit was split into, as far as their threads were sampled."""
    return codegen_units(hits).groupBy(*UNIT).agg(F.count_distinct("codegen_unit").alias("codegen_units"))


def trait_cost(hits: DataFrame) -> DataFrame:
    """Samples inside the trait solver and all samples, per unit and thread class."""
    return hits.groupBy(*UNIT, "thread").agg(
        F.sum(F.when(F.col("traits"), F.col("samples")).otherwise(F.lit(0))).alias("trait_samples"),
        F.sum("samples").alias("samples"),
    )


def build_script_runs(threads: DataFrame) -> DataFrame:
    """Build-script processes and their wall seconds."""
    program = flags.base_name(F.element_at(F.split("process_name", r"\s+"), 1))
    return (
        threads.where(F.startswith(program, F.lit("build-script-")))
        .groupBy("profile_id", "process_name")
        .agg((F.round((F.max("shutdown_ms") - F.min("startup_ms")) * 1000) / 1e6).alias("wall_s"))
    )
