"""Building session documents from redacted event logs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeclock.functions import coerce, ids
from forgeclock.operators import redact
from forgeclock.shared import growing
from forgeclock.sources.logs import run_headers

# Events per document part; larger builds are written as several parts.
PART_EVENTS = 50_000


def _quoted(value: Column) -> Column:
    """A text as a JSON string; null stays null."""
    listed = F.to_json(F.array(value))
    return F.when(value.isNotNull(), listed.substr(F.lit(2), F.length(listed) - 2))


def build_documents(
    events: DataFrame,
    headers: DataFrame,
    client: str,
    version_field: str = "payload_schema",
    part_events: int = PART_EVENTS,
    key: str = "run_id",
) -> DataFrame:
    """(key, part, body): one JSON document per build, split only when oversized.

    ``events`` is (key, pos, event JSON text, reason); ``headers`` has one row per key:
    run_id, env, machine, load, phases, timings, ... as JSON text or null, and
    ``units_withheld``.  A part spans ``part_events`` values of ``pos``; all parts carry the key as ``build``, so
    readers put them together from any number of files, and only a build's first part carries the header fields.
    """
    part = F.floor(F.col("pos") / part_events).cast("bigint")
    pieces = (
        events.groupBy(key, part.alias("part"))
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", "event"))), lambda s: s["event"]), ","
            ).alias("events_text"),
            F.min("pos").alias("first_pos"),
        )
    )
    totals = events.groupBy(key).agg(
        F.count_distinct(part).alias("n_parts"),
        F.min(part).alias("first_part"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("reason") == "unit-registered").alias("n_units"),
        F.count_if(F.col("reason") == "unit-section-finished").alias("n_sections"),
        F.count_if(F.col("reason") == "unit-finished").alias("n_finished"),
    )
    side = [c for c in headers.columns if c not in (key, "run_id", "units_withheld")]
    joined = pieces.join(growing(totals), key).join(growing(headers), key, "left")

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null")))

    counts = F.to_json(
        F.struct(
            F.col("n_events").alias("events"),
            F.col("n_units").alias("units"),
            F.col("n_sections").alias("sections"),
            F.coalesce("units_withheld", F.lit(0)).alias("units_withheld"),
        )
    )
    body = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            field(version_field, F.lit("1")),
            field("client", F.lit(json.dumps(client))),
            field("build", _quoted(F.col(key))),
            field("run_id", _quoted(F.col("run_id"))),
            field("part", F.col("part").cast("string")),
            field("parts", F.col("n_parts").cast("string")),
            field("first_pos", F.col("first_pos").cast("string")),
            *[field(c, F.when(F.col("part") == F.col("first_part"), F.col(c))) for c in side],
            field("complete", (F.col("n_finished") == F.col("n_units")).cast("string")),
            field("counts", counts),
            F.concat(F.lit('"events":['), F.col("events_text"), F.lit("]")),
        ),
        F.lit("}"),
    )
    return joined.select(key, "part", body.alias("body"))


# Header fields that go into ``env``.
ENV_FIELDS = ("host", "profile", "jobs", "num_cpus", "rustc_version", "rustc_version_verbose", "timestamp")

# Fixed value: what the collecting host knows and the log doesn't; it becomes part of ``env``.
HOST_FIELD = "ci"

# Payload fields that other operators supply as JSON text.
PAYLOAD = ("repository", "machine", "load", "artifacts", "phases", "timings", "build_env")

# Log bytes per document part; positions of log lines are byte based.
PART_BYTES = 1 << 26


def documents_from_logs(
    events: DataFrame,
    client: str,
    project_public: Column | None = None,
    payload: dict[str, DataFrame] | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(log, part, body): redacted session documents of valid logs (log, pos, e).

    ``project_public`` may refer to further columns of ``events``.  ``payload`` gives, by field name, one JSON text per
    log as (log, value): the machine, load summary, artifact bytes, sampled phases, report timings or build
    environment that their operators made.  Every field of ``PAYLOAD`` is in each document, null where nothing is known.
    ``ci`` in ``payload`` says by the JSON text ``true`` or ``false`` whether the build ran on a CI host, and goes into ``env``.
    """
    e = F.col("e")
    started = F.when(coerce.text(e, "$.reason") == redact.BUILD_STARTED, F.col("pos"))
    env = F.map_filter(F.try_variant_get(e, "$", "map<string,variant>"), lambda k, _: k.isin(*ENV_FIELDS))
    last = events.groupBy("log").agg(F.max_by(F.to_json(env), started).alias("env"))
    typed = events.withColumn("s", F.try_variant_get("e", "$", coerce.EVENT)).select(
        *events.columns, *coerce.event_columns(F.col("s"))
    )
    hidden = F.when(
        (F.col("reason") == redact.REGISTERED) & ~ids.is_public(F.col("package_id"), project_public), F.col("index")
    )
    withheld = typed.groupBy("log").agg(F.count_distinct(hidden).alias("units_withheld"))
    runs = run_headers(events).select("log", "run_id")
    headers = runs.join(growing(last), "log").join(growing(withheld), "log")
    if payload and HOST_FIELD in payload:
        host = payload[HOST_FIELD].select("log", F.col("value").alias("__ci"))
        said = F.concat(F.lit(f'"{HOST_FIELD}":'), F.col("__ci"), F.lit("}"))
        bare = F.coalesce("env", F.lit("{}"))
        joined = F.concat(F.substring(bare, 1, F.length(bare) - 1), F.when(bare != "{}", F.lit(",")).otherwise(F.lit("")), said)
        headers = headers.join(growing(host), "log", "left").withColumn("env", F.when(F.col("__ci").isNotNull(), joined).otherwise(F.col("env"))).drop("__ci")
    for name in PAYLOAD:
        if payload and name in payload:
            headers = headers.join(growing(payload[name].select("log", F.col("value").alias(name))), "log", "left")
        else:
            headers = headers.withColumn(name, F.lit(None).cast("string"))
    kept = redact.redact_log(events, project_public)
    return build_documents(kept, headers, client, part_events=part_bytes, key="log")
