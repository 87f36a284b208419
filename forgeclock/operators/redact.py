"""Redaction of event logs: nothing about private units is kept but their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeclock.functions import coerce, ids
from forgeclock.shared import growing

REGISTERED = "unit-registered"
BUILD_STARTED = "build-started"


def private_units(
    events: DataFrame, key: str = "object_key", project_public: Column | None = None, strict_git: bool = True
) -> DataFrame:
    """Distinct (key, index) of registrations that are not public."""
    public = ids.is_public(F.col("package_id"), project_public, strict_git)
    return (
        events.where((F.col("reason") == REGISTERED) & F.col("index").isNotNull() & ~public)
        .select(key, "index")
        .distinct()
    )


def hide_units(
    events: DataFrame, private: DataFrame, key: str = "object_key", keep_hidden: bool = False
) -> DataFrame:
    """Drop events of private units and prune edges that point at them.

    ``keep_hidden`` leaves the private numbers each event mentioned in ``hidden``.

    Every unit number an event mentions is looked up by an equi-join, so a build of
    any size spreads over tasks; per event only its own hits are gathered.
    """
    no_edges = F.array().cast("array<bigint>")
    mentioned = F.array_distinct(
        F.concat(
            F.array("index"),
            F.coalesce("dependencies", no_edges),
            F.coalesce("unblocked", no_edges),
        )
    )
    hits = (
        events.select(key, "pos", F.explode(mentioned).alias("index"))
        .join(growing(private), [key, "index"])
        .groupBy(key, "pos")
        .agg(F.collect_set("index").alias("hidden"))
    )
    own = F.coalesce(F.array_contains("hidden", F.col("index")), F.lit(False))
    return (
        events.join(growing(hits), [key, "pos"], "left")
        .where(~own)
        .withColumns({
            "dependencies": ids.prune_edges(F.col("dependencies"), F.col("hidden")),
            "unblocked": ids.prune_edges(F.col("unblocked"), F.col("hidden")),
        })
        .select(*events.columns, *(["hidden"] if keep_hidden else []))
    )


def redact_log(
    events: DataFrame, project_public: Column | None = None, strict_git: bool = True, strict_values: bool = False
) -> DataFrame:
    """(log, pos, reason, event): redacted events as JSON text, otherwise verbatim.

    ``events`` is (log, pos, e) with each event as VARIANT, plus any column that
    ``project_public`` refers to.  Fields nobody knows pass through; only edges, local
    package ids, the command and the path fields change.
    """
    typed = events.withColumn("s", F.try_variant_get("e", "$", coerce.EVENT)).select(
        *events.columns, *coerce.event_columns(F.col("s"))
    )
    private = private_units(typed, "log", project_public, strict_git)
    kept = hide_units(typed, private, "log", keep_hidden=True)
    e, reason = F.col("e"), F.col("reason")
    hidden = F.coalesce("hidden", F.array().cast("array<bigint>"))
    header = F.coalesce(reason == BUILD_STARTED, F.lit(False))

    def change(name: str, value: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("k"), value.cast("variant").alias("v")))

    def pruned(name: str) -> Column:
        edges = coerce.items(e, f"$.{name}")
        left = F.filter(edges, lambda x: ~F.coalesce(F.array_contains(hidden, coerce.integer(x)), F.lit(False)))
        return change(name, F.to_variant_object(left), edges.isNotNull())

    command = F.transform(
        coerce.items(e, "$.command"),
        lambda x: F.when(F.schema_of_variant(x) == "STRING", coerce.text(x)),
    )
    local = F.startswith("package_id", F.lit(ids.LOCAL_PREFIX))
    changes = F.filter(
        F.array(
            pruned("dependencies"),
            pruned("unblocked"),
            change("package_id", ids.canonical_id(F.col("package_id")), local),
            change("command", F.to_variant_object(ids.scrub_command(command, strict_values)), header & command.isNotNull()),
        ),
        lambda c: c.isNotNull(),
    )
    changed = F.transform(changes, lambda c: c["k"])
    fields = F.map_filter(
        F.try_variant_get(e, "$", "map<string,variant>"),
        lambda k, _: ~F.array_contains(changed, k) & ~(header & k.isin(*ids.PRIVATE_HEADER_FIELDS)),
    )
    return kept.select(
        "log", "pos", "reason", F.to_json(F.map_concat(fields, F.map_from_entries(changes))).alias("event")
    )


def redact(
    events: DataFrame, key: str = "object_key", project_public: Column | None = None, strict_git: bool = True
) -> DataFrame:
    """Redacted events: private units gone, edges pruned, local ids made canonical."""
    private = private_units(events, key, project_public, strict_git)
    return hide_units(events, private, key).withColumn("package_id", ids.canonical_id(F.col("package_id")))


def withheld_counts(events: DataFrame, key: str = "object_key", strict_git: bool = True) -> DataFrame:
    """Number of private units per build, 0 included."""
    hidden = F.when(
        (F.col("reason") == REGISTERED) & ~ids.is_public(F.col("package_id"), strict_git=strict_git),
        F.col("index"),
    )
    return events.groupBy(key).agg(F.count_distinct(hidden).alias("units_withheld"))


def scrub_headers(headers: DataFrame, strict_values: bool = False) -> DataFrame:
    """Header rows without private fields and with a scrubbed command line."""
    return headers.drop(*ids.PRIVATE_HEADER_FIELDS).withColumn(
        "command", ids.scrub_command(F.col("command"), strict_values)
    )


def attach_repository(events: DataFrame, projects: DataFrame, key: str = "object_key") -> DataFrame:
    """Repository of a public project on the first event of each build; null elsewhere.

    ``events`` carries ``workspace_root``; ``projects`` is
    (workspace_root, project_public, repository).
    """
    linked = projects.where(F.col("project_public") & (F.coalesce("repository", F.lit("")) != "")).select(
        "workspace_root", F.col("repository").alias("__repo")
    )
    first = events.groupBy(key).agg(F.min("pos").alias("pos"), F.max("workspace_root").alias("workspace_root"))
    marked = first.join(linked, "workspace_root").select(key, "pos", F.col("__repo").alias("repository"))
    return events.join(marked, [key, "pos"], "left")


def public_crates(events: DataFrame, key: str = "object_key") -> DataFrame:
    """Target names of kept registrations in log order, repeats kept."""
    return events.where((F.col("reason") == REGISTERED) & F.col("target_name").isNotNull()).select(
        key, "pos", F.col("target_name").alias("crate")
    )


def unsent(sessions: DataFrame, ledger: DataFrame, named: Column | None = None) -> DataFrame:
    """Sessions whose run id is not in the ledger, one per run; ``named`` rows always pass."""
    seen = ledger.select("run_id").distinct()
    fresh = sessions.join(seen, "run_id", "left_anti")
    if named is not None:
        fresh = sessions.where(F.coalesce(named, F.lit(False))).unionByName(
            sessions.where(~F.coalesce(named, F.lit(False))).join(seen, "run_id", "left_anti")
        )
    return fresh.dropDuplicates(["run_id"])


def extend_ledger(ledger: DataFrame, sent: DataFrame) -> DataFrame:
    """Ledger after a successful send; repeating it changes nothing."""
    return ledger.select("run_id").union(sent.select("run_id")).distinct()


def forget_machine(table: DataFrame, sessions: DataFrame, machine_id: str) -> DataFrame:
    """Rows of a table without any build recorded under one machine id."""
    gone = sessions.where(F.col("machine_id") == machine_id).select("run_id").distinct()
    return table.join(gone, "run_id", "left_anti")


def exclude_contributors(sessions: DataFrame, excluded: DataFrame) -> DataFrame:
    """Sessions that match no row of an exclusion table on all its columns."""
    return sessions.join(excluded, list(excluded.columns), "left_anti")


def restrict_to_public(table: DataFrame, crates: DataFrame) -> DataFrame:
    """Rows of phases or unit_flags whose crate was published by the same build."""
    allowed = crates.select("run_id", F.translate("crate", "-", "_").alias("crate")).distinct()
    return table.join(allowed, ["run_id", "crate"], "left_semi")
