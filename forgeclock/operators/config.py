"""Machine, load and build-configuration tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeclock.functions import flags
from forgeclock.functions.text import strip

STALL_KINDS = ("cpu", "io", "memory")
# A file of a deps folder: the crate is what precedes the last dash of the stem, without a
# leading lib.  First with an extension, then without one (a leading dot is no extension).
ARTIFACT = (
    r"(?s)^.*/(?:debug|release)/deps/(?:lib)?+"
    r"(?:([^/]*)-[^/-]*?\.([^./]*)|(\.?[^./]*)-[^./-]*)$"
)
ARTIFACT_KINDS = {"rmeta": "rmeta", "rlib": "rlib", "o": "obj"}


def load_summary(samples: DataFrame) -> DataFrame:
    """Mean and maximum load per build; a host without load average gives null, not 0."""
    usable = F.max("loadavg") > 0
    return samples.groupBy("run_id").agg(
        F.when(usable, F.avg("loadavg")).alias("loadavg_mean"),
        F.when(usable, F.max("loadavg")).alias("loadavg_max"),
        F.avg("cpu_pct").alias("cpu_busy_mean"),
        F.max("cpu_pct").alias("cpu_busy_max"),
        F.count(F.lit(1)).alias("samples"),
    )


def stall_seconds(samples: DataFrame) -> DataFrame:
    """Stalled seconds per kind: last minus first counter, never below zero."""
    out = []
    for kind in STALL_KINDS:
        first, last = F.min_by(f"psi_{kind}", "ts"), F.max_by(f"psi_{kind}", "ts")
        both = first.isNotNull() & last.isNotNull()
        out.append(F.when(both, F.greatest(F.lit(0), last - first) / 1e6).alias(kind))
    return samples.groupBy("run_id").agg(*out)


def machine_id(env_id: Column, project_id: Column, file_id: Column) -> Column:
    """First present source decides; blank or ``none`` means no id. A blank file is absent."""
    chosen = F.coalesce(env_id, project_id, F.nullif(strip(file_id), F.lit("")))
    return F.nullif(F.nullif(strip(chosen), F.lit("")), F.lit("none"))


def memory_gb(size: Column) -> Column:
    """Bytes to the nearest GiB."""
    return F.floor((size + F.lit(1 << 29)) / F.lit(1 << 30)).cast("bigint")


def environment(variables: DataFrame) -> DataFrame:
    """Whitelisted environment (run_id, name, value) with safe values; flags as an array text."""
    kept = variables.where(F.col("name").isin(*flags.ENV_VARIABLES))
    name, value = F.col("name"), F.col("value")
    safe = (
        F.when(name == "RUSTFLAGS", F.to_json(flags.sanitised_flags(value)))
        .when(name == "CARGO_ENCODED_RUSTFLAGS", F.to_json(flags.sanitised_flags(value, encoded=True)))
        .when(name.isin("RUSTC_WRAPPER", "RUSTC_WORKSPACE_WRAPPER"), flags.program_name(value))
        .otherwise(value)
    )
    return kept.select("run_id", "name", safe.alias("value")).where("value IS NOT NULL")


def merged_config(layers: DataFrame) -> DataFrame:
    """Whitelisted configuration per build; the workspace layer overrides home key by key."""
    key, value = F.col("key"), F.col("value")
    plain = key.isin("build.incremental", "build.target", "build.jobs")
    program = key.isin("build.rustc-wrapper", "build.rustc-workspace-wrapper") | key.rlike(r"^target\..*\.linker$")
    rustflags = (key == "build.rustflags") | key.rlike(r"^target\..*\.rustflags$")
    # A list keeps its elements as they are, commas inside included; plain text is split at spaces.
    listed = F.array_join(F.try_variant_get(F.try_parse_json(value), "$", "array<string>"), "\x1f")
    safe_flags = F.coalesce(flags.sanitised_flags(listed, encoded=True), flags.sanitised_flags(F.trim(value, F.lit('"'))))
    safe = (
        F.when(plain, F.trim(value, F.lit('"')))
        .when(program, flags.program_name(F.trim(value, F.lit('"'))))
        .when(rustflags, F.to_json(safe_flags))
    )
    rank = F.when(F.col("layer") == "workspace", F.lit(1)).otherwise(F.lit(0))
    return (
        layers.select("run_id", "key", safe.alias("value"), rank.alias("rank"))
        .where("value IS NOT NULL")
        .groupBy("run_id", "key")
        .agg(F.max_by("value", "rank").alias("value"))
    )


def crate_bytes(listing: DataFrame) -> DataFrame:
    """Artifact bytes per target folder and crate from a file listing (target_dir, path, length)."""
    marked = F.regexp_replace("path", ARTIFACT, "\x1f$1$3\x1f$2")
    ext = F.split_part(marked, F.lit("\x1f"), F.lit(3))
    return (
        listing.where(F.startswith(marked, F.lit("\x1f")))
        .groupBy("target_dir", F.split_part(marked, F.lit("\x1f"), F.lit(2)).alias("crate"))
        .agg(
            *[
                F.coalesce(F.sum(F.when(ext == e, F.col("length"))), F.lit(0)).alias(n)
                for e, n in ARTIFACT_KINDS.items()
            ]
        )
    )


def public_bytes(per_crate: DataFrame, crates: DataFrame, distinct: bool = False) -> DataFrame:
    """Crate bytes restricted to published crates (target_dir, crate), with multiplicity."""
    names = crates.select("target_dir", F.translate("crate", "-", "_").alias("crate"))
    listed = names.groupBy("target_dir", "crate").agg(F.count(F.lit(1)).alias("listed"))
    if distinct:
        listed = listed.withColumn("listed", F.lit(1).cast("bigint"))
    return per_crate.join(listed, ["target_dir", "crate"])


def byte_totals(restricted: DataFrame) -> DataFrame:
    """Totals per target folder; a crate listed twice counts twice."""
    return restricted.groupBy("target_dir").agg(
        *[F.sum(F.col(n) * F.col("listed")).alias(n) for n in ARTIFACT_KINDS.values()]
    )
