"""Raw session documents to the five published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeclock import schemas
from forgeclock.functions import coerce, ids
from forgeclock.operators.ordered import running_last
from forgeclock.shared import materialise

# Sections with a column of their own; other names are ignored.
SECTIONS = ("frontend", "codegen", "link")

# Head fields that the sessions table reads.
SESSION_HEAD = (*[f.name for f in schemas.SESSIONS if f.name != "object_key"], "part", "parts")

# Events of one build that share a window task.
SEGMENT_EVENTS = 65_536


def with_fault(parsed: DataFrame) -> DataFrame:
    """Add ``fault``: why a parsed document cannot be flattened, or null when it can.

    Each list is cut out of the document once and then tested member by member.
    """
    v = F.col("v")
    lists = {
        "events": "$.events",
        "phases": "$.phases.units",
        "concurrency": "$.timings.concurrency_data",
        "cpu_usage": "$.timings.cpu_usage",
    }

    def present(path):
        item = F.try_variant_get(v, path, "variant")
        return item.isNotNull() & ~F.is_variant_null(item)

    cut = parsed.select(
        "*",
        *[coerce.items(v, path).alias(f"__l_{n}") for n, path in lists.items()],
        *[present(path).alias(f"__p_{n}") for n, path in lists.items()],
    )

    def no_list(name):
        return F.col(f"__p_{name}") & F.col(f"__l_{name}").isNull()

    def some(name, test):
        return F.coalesce(F.exists(f"__l_{name}", test), F.lit(False))

    def nothing(x):
        return x.isNull() | F.is_variant_null(x)

    def odd_id(e):
        pid = F.try_variant_get(e, "$.package_id", "variant")
        kind = F.schema_of_variant(pid)
        return (
            F.when(coerce.text(e, "$.reason") != "unit-registered", F.lit(False))
            .when(pid.isNull() | kind.isin("STRING", "VOID"), F.lit(False))
            .otherwise(F.coalesce(coerce.truth(pid), F.lit(False)))
        )

    fault = (
        F.when(v.isNull(), F.lit("not json"))
        .when(F.is_variant_null(v), F.lit("null document"))
        .when(no_list("events") | some("events", nothing), F.lit("events"))
        .when(some("events", odd_id), F.lit("package_id"))
        .when(no_list("phases") | some("phases", nothing), F.lit("phases"))
        .when(no_list("concurrency") | some("concurrency", nothing), F.lit("concurrency"))
        .when(no_list("cpu_usage") | some("cpu_usage", lambda p: coerce.items(p).isNull()), F.lit("cpu_usage"))
    )
    return cut.select(*parsed.columns, fault.alias("fault"))


def shaped(docs: DataFrame, version_field: str = "payload_schema", fields: Sequence[str] | None = None) -> DataFrame:
    """Replace ``v`` by the parts the tables read: ``head`` scalars (all of them, or ``fields``), typed ``events``, ``sampled`` and ``timings``.

    Written like this, each table's scan reads its own part only.  A build split into documents carries its key as
    ``build``: all its parts are one build, in whatever files they lie.  Documents shaped before pass through.
    """
    if "head" in docs.columns:
        return docs
    v = F.col("v")
    build = coerce.text(v, "$.build")
    scalars = {"run_id": coerce.text(v, "$.run_id"), "client": coerce.text(v, "$.client")}
    scalars |= {"schema": coerce.integer(v, f"$.{version_field}")}
    scalars |= {c: coerce.text(v, f"$.env.{c}") for c in ("timestamp", "rustc_version", "profile")}
    scalars |= {"jobs": coerce.integer(v, "$.env.jobs"), "ci": coerce.truth(v, "$.env.ci")}
    scalars |= {"complete": coerce.truth(v, "$.complete")}
    scalars |= {c: coerce.integer(v, f"$.counts.{c}") for c in ("events", "units", "units_withheld", "sections")}
    scalars |= {c: coerce.text(v, f"$.machine.{c}") for c in ("machine_id", "os", "arch", "cpu_model")}
    scalars |= {c: coerce.integer(v, f"$.machine.{c}") for c in ("cpu_cores", "mem_gb")}
    scalars |= {c: coerce.number(v, f"$.load.{c}") for c in ("loadavg_mean", "cpu_busy_mean")}
    scalars |= {c: coerce.integer(v, f"$.{c}") for c in ("part", "parts", "first_pos")}
    head = [scalars[name].alias(name) for name in (scalars if fields is None else fields)]
    typed = F.transform(
        F.try_variant_get(v, "$.events", f"array<{coerce.EVENT}>"), lambda e: F.struct(*coerce.event_columns(e))
    )
    rest = [c for c in docs.columns if c not in ("v", "object_key", "part")]
    return docs.select(
        F.coalesce(build, F.col("object_key")).alias("object_key"),
        *rest,
        F.struct(*head).alias("head"),
        typed.alias("events"),
        F.try_variant_get(v, "$.phases", "variant").alias("sampled"),
        F.try_variant_get(v, "$.timings", "variant").alias("timings"),
    )


def split_build() -> Column:
    """Whether a shaped document holds only a part of its build."""
    return F.col("head.part").isNotNull() & (F.coalesce("head.parts", F.lit(0)) != 1)


def event_rows(docs: DataFrame) -> DataFrame:
    """Typed event log: one row per event, ``pos`` keeps the order."""
    exploded = shaped(docs).select(
        "object_key",
        F.col("head.run_id").alias("run_id"),
        F.coalesce("head.first_pos", F.lit(0).cast("bigint")).alias("first"),
        F.posexplode("events").alias("i", "e"),
    )
    return exploded.select("object_key", "run_id", (F.col("first") + F.col("i")).alias("pos"), "e.*")


def unit_rows(events: DataFrame, segment_events: int = SEGMENT_EVENTS) -> DataFrame:
    """One row per registered unit of each document.

    A registration opens a new life of its unit and only the last life counts.  One
    window pass finds, per event, the registration, the start and the section starts
    in force; two aggregations reduce lives and then units.
    """
    reason, elapsed, section = F.col("reason"), F.col("elapsed"), F.col("section")
    registered = reason == "unit-registered"
    started = reason == "unit-started"
    finished = reason == "unit-finished"
    section_start = reason == "unit-section-started"
    section_end = reason == "unit-section-finished"

    useful = events.where(registered | started | finished | section_start | section_end)
    marks = {
        "reg_pos": F.when(registered, F.col("pos")),
        "start": F.when(started, F.struct(F.col("pos").alias("at"), elapsed.alias("elapsed"))),
    }
    for name in SECTIONS:
        marks[f"open_{name}"] = F.when(section_start & (section == name), elapsed)
    segment = F.floor(F.col("pos") / segment_events)
    ordered = running_last(useful, ["object_key", "index"], "pos", marks, segment)

    live_start = F.when(F.col("start.at") > F.col("reg_pos"), F.col("start.elapsed"))
    took = F.when(finished, elapsed - live_start)
    aggregates = [
        F.max("run_id").alias("run_id"),
        F.max(F.when(registered, F.col("target_name"))).alias("crate"),
        F.max(F.when(registered, F.col("package_id"))).alias("package_id"),
        F.max(F.when(registered, F.col("mode"))).alias("mode"),
        F.max_by("elapsed", F.when(started, F.col("pos"))).alias("started"),
        F.max_by("elapsed", F.when(finished, F.col("pos"))).alias("finished"),
        F.max_by(took, F.when(took.isNotNull(), F.col("pos"))).alias("duration"),
        F.max_by(
            F.when(F.col("unblocked").isNotNull(), F.size("unblocked")), F.when(finished, F.col("pos"))
        ).cast("bigint").alias("unblocked"),
    ]
    for name in SECTIONS:
        span = F.when(section_end & (section == name), elapsed - F.col(f"open_{name}"))
        aggregates.append(F.sum(span).alias(name))
    lives = (
        ordered.where(F.col("reg_pos").isNotNull())
        .groupBy("object_key", "index", "reg_pos")
        .agg(*aggregates)
    )
    fields = [c for c in lives.columns if c not in ("object_key", "index", "reg_pos")]
    last = lives.groupBy("object_key", "index").agg(F.max_by(F.struct(*fields), "reg_pos").alias("u"))
    units = last.select("object_key", "index", "u.*")
    sectioned = F.coalesce(*SECTIONS).isNotNull()
    rest = F.col("duration") - F.coalesce("codegen", F.lit(0.0)) - F.coalesce("link", F.lit(0.0))
    return units.withColumns({
        "package": ids.package_name(F.col("package_id")),
        "frontend": F.when(sectioned & F.col("duration").isNotNull(), rest).otherwise(F.col("frontend")),
    })


def section_spans(events: DataFrame, segment_events: int = SEGMENT_EVENTS) -> DataFrame:
    """Every section-finish of a unit's last life with the time since its section start.

    Starts are not used up, may precede the registration and count for any later finish.
    """
    starts = F.when(F.col("reason") == "unit-section-started", F.col("elapsed"))
    ends = (F.col("reason") == "unit-section-finished") & F.col("elapsed").isNotNull()
    last_life = (
        events.where(F.col("reason") == "unit-registered")
        .groupBy("object_key", "index")
        .agg(F.max("pos").alias("reg_pos"))
    )
    sections = events.where(
        F.col("reason").isin("unit-section-started", "unit-section-finished")
        & (F.coalesce("section", F.lit("")) != "")
    )
    segment = F.floor(F.col("pos") / segment_events)
    opened = running_last(
        sections, ["object_key", "index", "section"], "pos", {"opened": starts}, segment
    ).where(ends & F.col("opened").isNotNull())
    return (
        opened.join(last_life, ["object_key", "index"])
        .where(F.col("pos") > F.col("reg_pos"))
        .select("run_id", "index", "section", "pos", (F.col("elapsed") - F.col("opened")).alias("span"))
    )


def units_table(events: DataFrame, segment_events: int = SEGMENT_EVENTS) -> DataFrame:
    return unit_rows(events, segment_events).select(*schemas.UNITS.names)


def sessions_table(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document; a build split into parts has one row, from its first part that exists."""
    named = [F.col("head")[f.name].alias(f.name) for f in schemas.SESSIONS if f.name != "object_key"]
    rows = shaped(docs).select("object_key", *named, *keep, F.when(split_build(), F.col("head.part")).alias("__part"))
    rows = rows.select(*schemas.SESSIONS.names, *keep, "__part")
    fields = [c for c in rows.columns if c not in ("object_key", "__part")]
    parts = rows.where("__part IS NOT NULL").groupBy("object_key")
    first = parts.agg(F.min_by(F.struct(*fields), "__part").alias("s")).select("object_key", "s.*")
    return rows.where("__part IS NULL").drop("__part").unionByName(first)


def _sampled_units(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    v = F.col("sampled")
    return shaped(docs).select(
        *keep,
        F.col("head.run_id").alias("run_id"),
        coerce.integer(v, "$.rate_hz").alias("rate_hz"),
        coerce.text(v, "$.sampler").alias("sampler"),
        F.explode(coerce.items(v, "$.units")).alias("u"),
    ).select(
        "*", *[coerce.text(F.col("u"), f"$.{c}").alias(c) for c in ("crate", "package", "crate_type")]
    )


def phases_table(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Sampled units x thread class x phase, in one scan."""
    u = F.col("u")
    nothing = F.array().cast("array<struct<thread:string,phase:string,samples:bigint>>")

    def side(thread):
        return F.coalesce(
            F.transform(
                coerce.entries(u, f"$.{thread}"),
                lambda e: F.struct(
                    F.lit(thread).alias("thread"), e["key"].alias("phase"), coerce.integer(e["value"]).alias("samples")
                ),
            ),
            nothing,
        )

    return (
        _sampled_units(docs, keep)
        .select("*", F.inline(F.concat(side("serial"), side("parallel"))))
        .withColumn("wall_s", coerce.number(u, "$.wall_s"))
        .select(*schemas.PHASES.names, *keep)
    )


def unit_flags_table(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per sampled unit and setting, the value as text."""
    return (
        _sampled_units(docs, keep)
        .select("*", F.explode(coerce.entries(F.col("u"), "$.flags")).alias("f"))
        .select("*", F.col("f.key").alias("flag"), F.coalesce(coerce.text(F.col("f.value")), F.lit("null")).alias("value"))
        .select(*schemas.UNIT_FLAGS.names, *keep)
    )


def timeline_table(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Concurrency points and CPU pairs as sparse rows of one table, in one scan."""
    v = F.col("timings")
    row = "array<struct<t:double,active:bigint,waiting:bigint,inactive:bigint,cpu_pct:double>>"
    nothing = F.array().cast(row)
    points = F.transform(
        coerce.items(v, "$.concurrency_data"),
        lambda c: F.struct(
            coerce.number(c, "$.t").alias("t"),
            *[coerce.integer(c, f"$.{n}").alias(n) for n in ("active", "waiting", "inactive")],
            F.lit(None).cast("double").alias("cpu_pct"),
        ),
    )
    pairs = F.transform(
        coerce.items(v, "$.cpu_usage"),
        lambda p: F.struct(
            coerce.number(p, "$[0]").alias("t"),
            *[F.lit(None).cast("bigint").alias(n) for n in ("active", "waiting", "inactive")],
            coerce.number(p, "$[1]").alias("cpu_pct"),
        ),
    )
    return shaped(docs).select(
        F.col("head.run_id").alias("run_id"),
        F.inline(F.concat(F.coalesce(points, nothing), F.coalesce(pairs, nothing))),
        *keep,
    ).select(*schemas.TIMELINE.names, *keep)


def five_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """All published tables of well-formed documents.

    Typed events are written once, because the unit flattening reads them twice.
    """
    return {
        "units": units_table(materialise(event_rows(docs), "events")),
        "sessions": sessions_table(docs),
        "phases": phases_table(docs),
        "timeline": timeline_table(docs),
        "unit_flags": unit_flags_table(docs),
    }


def event_counts(events: DataFrame, key: str = "object_key") -> DataFrame:
    """Counts and completeness of each build from its kept events."""
    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("reason") == "unit-registered").alias("units"),
        F.count_if(F.col("reason") == "unit-section-finished").alias("sections"),
        (
            F.count_if(F.col("reason") == "unit-finished") == F.count_if(F.col("reason") == "unit-registered")
        ).alias("complete"),
    )
