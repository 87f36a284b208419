"""Raw session documents derived from ``orders``: one JSON document per order.

The documents drift on purpose: numbers as text, booleans as text or numbers,
missing and null subtrees, so that parsing and coercion have work to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeclock.plans.lens import table
from forgeclock.sources.lake import date_columns

_BODY = """concat(
 '{"payload_schema":', IF(q % 7 = 0, '"1"', '1'), ',"client":"client 0.', q % 3, '","run_id":"o', q, '"',
 ',"complete":', CASE q % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '"false"' ELSE '0' END,
 ',"env":{"timestamp":"', date_format(d, 'yyyy-MM-dd'), 'T00:00:00Z","rustc_version":"1.', 70 + q % 12,
 '","profile":"dev","jobs":', IF(q % 5 = 0, '" 8 "', CAST(q % 16 AS STRING)),
 IF(q % 5 = 4, '', concat(',"ci":', CASE q % 5 WHEN 0 THEN '""' WHEN 1 THEN 'true' WHEN 2 THEN 'null' ELSE '2' END)), '}',
 ',"machine":{"machine_id":"m', c, '","os":"linux","cpu_cores":8.0,"mem_gb":', c % 30, '.9}',
 ',"load":{"loadavg_mean":', IF(c % 3 = 0, 'null', concat('"', c % 8, '.5"')),
 ',"cpu_busy_mean":', IF(c % 3 = 1, '"Infinity"', CAST(c % 100 AS STRING)), '}',
 ',"counts":{"events":', IF(q % 3 = 0, '6', '5'), ',"units":"', IF(q % 3 = 0, 2, 1), '","sections":1}',
 ',"phases":', IF(q % 6 = 5, 'null', concat('{"sampler":"samply","rate_hz":4999,"units":[{"crate":"a', c % 50,
   '","package":"a-1.0.', c % 50, '","crate_type":"lib","flags":{"opt-level":"', q % 4, '","lto":true,"level":', q % 3,
   '},"wall_s":', q % 60, '.25,"serial":{"type_check":', q % 40, ',"borrowck":"', c % 10, '.9"},"parallel":{',
   IF(q % 2 = 0, concat('"codegen":', c % 9), ''), '}}]}')),
 ',"timings":', IF(q % 5 = 4, 'null', concat('{"concurrency_data":[{"t":0.25,"active":1,"waiting":', q % 3,
   ',"inactive":2}],"cpu_usage":[[0.5,', q % 101, '],[1,"', c % 7, '"]]}')),
 ',"events":[{"reason":"unit-registered","index":0,"mode":"build","target":{"name":"a', c % 50,
   '"},"package_id":"registry+https://github.com/rust-lang/crates.io-index#a', c % 50, '@1.0.', c % 50,
   '","dependencies":[1]},{"reason":"unit-started","index":0,"elapsed":0.5},',
   '{"reason":"unit-section-started","index":"0","section":"codegen","elapsed":1},',
   '{"reason":"unit-section-finished","index":0,"section":"codegen","elapsed":"', 1 + q % 3, '.5"},',
   '{"reason":"unit-finished","index":0,"elapsed":', 5 + q % 20, ',"unblocked":', IF(q % 2 = 0, '[1]', '7'), '}',
   IF(q % 3 = 0, ',{"reason":"unit-registered","index":1,"mode":"build","target":{"name":"b"},"package_id":"path+file:///x"}', ''),
 ']}')"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(object_key, body, year, month, day): raw documents as they would be stored."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS q", "o_custkey AS c", "o_orderdate AS d")
    # A few bytes per row become a document of a kilobyte: spread rows before they grow.
    o = o.repartition(spark.sparkContext.defaultParallelism)
    return o.select(
        F.concat(F.lit("sessions/o"), "q", F.lit(".json.zst")).alias("object_key"),
        F.expr(_BODY).alias("body"),
        *date_columns(F.col("d")),
    )


def damaged(spark: SparkSession, sf: str) -> DataFrame:
    """The same documents, some broken: cut text, wrong shapes, null members."""
    n = F.regexp_extract("object_key", r"o(\d+)", 1).cast("bigint")
    return documents(spark, sf).withColumn(
        "body",
        F.when(n % 11 == 0, F.col("body").substr(F.lit(1), F.length("body") - 3))
        .when(n % 13 == 0, F.replace("body", F.lit('"cpu_usage":['), F.lit('"cpu_usage":[5,')))
        .when(n % 17 == 0, F.replace("body", F.lit('"events":['), F.lit('"events":[null,')))
        .when(n % 19 == 0, F.replace("body", F.lit('"package_id":"reg'), F.lit('"package_id":9,"x":"reg')))
        .when(n % 23 == 0, F.replace("body", F.lit('"units":[{'), F.lit('"units":[null,{')))
        .otherwise(F.col("body")),
    )


def log_events(spark: SparkSession, sf: str) -> DataFrame:
    """The event log lens with each event as JSON text: (run_id, pos, reason, event)."""
    from forgeclock.plans.lens import event_log

    event = F.to_json(
        F.struct(
            "reason", "index", "elapsed", "section", "package_id",
            F.when(F.col("target_name").isNotNull(), F.struct(F.col("target_name").alias("name"))).alias("target"),
            "mode", "dependencies", "unblocked",
        )
    )
    return event_log(spark, sf).select("run_id", "pos", "reason", event.alias("event"))


def built_documents(spark: SparkSession, sf: str, part_events: int = 50_000) -> DataFrame:
    """Session documents built from the event log lens: (object_key, body, year, month, day)."""
    from forgeclock.sources.documents import build_documents

    e = table(spark, sf, "events")
    first = e.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"))
    headers = first.select(
        F.concat(F.lit("u"), "user_id").alias("run_id"),
        F.to_json(
            F.struct(F.date_format("first_ts", "yyyy-MM-dd").alias("timestamp"), F.lit("dev").alias("profile"))
        ).alias("env"),
        F.to_json(F.struct(F.concat(F.lit("m"), F.col("user_id") % 10).alias("machine_id"))).alias("machine"),
        (F.col("user_id") % 3).alias("units_withheld"),
    )
    docs = build_documents(log_events(spark, sf), headers, "lens 1.0", part_events=part_events)
    dates = first.select(F.concat(F.lit("u"), "user_id").alias("run_id"), *date_columns(F.col("first_ts")))
    return docs.join(dates, "run_id").select(
        F.concat(F.lit("sessions/"), "run_id", F.lit(".json.zst")).alias("object_key"), "part", "body", "year", "month", "day"
    )
