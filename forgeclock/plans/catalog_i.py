"""Registered queries: streaming (I). Streams are drained to files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from forgeclock.operators.ordered import exact_quantiles
from forgeclock.plans import lens, raw_lens
from forgeclock.plans.lens import over, table
from forgeclock.shared import fresh_folder
from forgeclock.sources.ledger import source_of
from forgeclock.streaming import jobs, quiescence

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def folders(spark, label):
    base = fresh_folder(spark, label)
    return f"{base}/out", f"{base}/checkpoint"


def stream_of(spark, sf, name):
    return jobs.file_stream(spark, sf, table(spark, sf, name).schema, glob=f"{name}.parquet")


@query("i1_streaming_compaction", over("events", body="""
    WITH reg AS (SELECT run_id, index, max(pos) AS rp FROM ev WHERE reason = 'unit-registered' GROUP BY 1, 2)
    SELECT r.run_id, r.index, arg_max_null(f.elapsed, f.pos) AS finished FROM reg r
    LEFT JOIN ev f ON f.run_id = r.run_id AND f.index = r.index AND f.pos > rp AND f.reason = 'unit-finished' GROUP BY 1, 2"""))
def i1(spark, sf):
    arriving = fresh_folder(spark, "arriving")
    docs = raw_lens.built_documents(spark, sf).select("object_key", "part", "body")
    docs.repartition(3, "object_key").write.parquet(arriving)
    out, checkpoint = folders(spark, "stream-compact")
    jobs.streaming_compaction(jobs.file_stream(spark, arriving, docs.schema, per_trigger=1), out, checkpoint)
    return jobs.compacted(spark, out, "units").select("run_id", "index", "finished")


@query("i2_quiescent_runs", """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g)
    SELECT 'u' || user_id AS run_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS events
    FROM s GROUP BY user_id, burst HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def i2(spark, sf):
    events = stream_of(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    out, checkpoint = folders(spark, "quiescent")
    done = jobs.drain(jobs.quiescent_runs(events, "6 hours", "1 hour"), out, checkpoint)
    return done.select(
        "run_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "events"
    )


_HOUR = 3_600_000_000

_POLLS = "concat('u', user_id) AS run_id, CAST(ts AS TIMESTAMP) AS ts, CAST(CASE user_id % 5 WHEN 0 THEN 0 WHEN 1 THEN day(ts) % 3 ELSE event_id END AS BIGINT) AS size"


@query("i2_log_outcomes", f"""
    WITH p AS (SELECT run_id, epoch_us(ts) AS t, max(size) AS size FROM (SELECT {_POLLS} FROM events) GROUP BY 1, 2),
    l AS (SELECT *, lag(size) OVER (PARTITION BY run_id ORDER BY t) AS before FROM p),
    c AS (SELECT *, t + 12 * {_HOUR} AS rest, lead(t) OVER (PARTITION BY run_id ORDER BY t) AS next FROM l WHERE before IS NULL OR before <> size),
    b AS (SELECT run_id, min(t) + 96 * {_HOUR} AS cap FROM p GROUP BY 1),
    q AS (SELECT run_id, min(rest) AS at, arg_min(size, t) AS size FROM c JOIN b USING (run_id)
      WHERE size > 0 AND (next IS NULL OR next > rest) AND rest < cap GROUP BY 1),
    z AS (SELECT run_id, any_value(cap) AS cap, arg_max(size, t) AS size FROM p JOIN b USING (run_id) WHERE t < cap GROUP BY 1)
    SELECT run_id, CASE WHEN q.at IS NOT NULL THEN 'quiet' WHEN z.size > 0 THEN 'given up' ELSE 'empty' END AS outcome,
      coalesce(q.at, cap) AS at, CAST(coalesce(q.size, z.size) AS BIGINT) AS size
    FROM z LEFT JOIN q USING (run_id)""")
def i2_outcomes(spark, sf):
    """Polls arrive in three parts by time, and the stream is drained after each; logs undecided at the end are settled."""
    polls = table(spark, sf, "events").select(F.expr("struct(" + _POLLS + ")").alias("p")).select("p.*")
    first, last = polls.agg(F.min("ts"), F.max("ts")).first()
    arriving, (out, checkpoint) = fresh_folder(spark, "polls"), folders(spark, "outcomes")
    third = (last - first) / 3
    rule = quiescence.Rule(quiet=12 * _HOUR, cap=96 * _HOUR, delay=_HOUR)
    for i in range(3):
        here = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) / F.lit(third.total_seconds() * 1e6)) == i
        here = here | (F.col("ts") == F.lit(last)) if i == 2 else here
        polls.where(here).write.mode("append").parquet(arriving)
        quiescence.watch(jobs.file_stream(spark, arriving, polls.schema), out, checkpoint, rule)
    return quiescence.settled(spark, out, rule)


@query("i3_single_delivery", """
    SELECT 'o' || l_orderkey AS run_id, CASE WHEN bool_or(l_linenumber % 2 = 1) THEN 'first' ELSE 'second' END AS stream
    FROM lineitem GROUP BY l_orderkey
    UNION ALL SELECT 'c' || c_custkey, 'second' FROM customer""")
def i3(spark, sf):
    """Two streams with checkpoints of their own share a ledger; the second sends most ids of the first again, and new ones."""
    lines = table(spark, sf, "lineitem").selectExpr("concat('o', l_orderkey) AS run_id", "l_linenumber % 2 = 1 AS odd")
    more = table(spark, sf, "customer").selectExpr("concat('c', c_custkey) AS run_id")
    out = fresh_folder(spark, "delivery")
    sources = {}
    for name, sends in (("first", lines.where("odd").drop("odd")), ("second", lines.drop("odd").unionByName(more))):
        arriving, checkpoint = fresh_folder(spark, "sends"), fresh_folder(spark, "checkpoint")
        sends.repartition(2).write.parquet(arriving)
        jobs.single_delivery(jobs.file_stream(spark, arriving, sends.schema, per_trigger=1), out, checkpoint)
        sources[name] = source_of(spark, checkpoint)
    stream = F.when(F.col("source") == sources["first"], "first").when(F.col("source") == sources["second"], "second")
    return jobs.delivered(spark, out, sends.schema).select("run_id", stream.alias("stream"))


@query("i4_load_windows", over("clicks", body="""
    SELECT 'u' || user_id AS run_id, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start_us, round(avg(k / 4.0::DOUBLE), 6) AS loadavg_mean,
      max(k)::DOUBLE AS cpu_busy_max, count(*) AS samples FROM clicks GROUP BY user_id, time_bucket(INTERVAL 6 HOUR, ts)
    HAVING time_bucket(INTERVAL 6 HOUR, min(ts)) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""))
def i4(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    samples = stream_of(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id").alias("run_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (k / F.lit(4.0)).alias("loadavg"),
        k.cast("double").alias("cpu_pct"),
    )
    out, checkpoint = folders(spark, "load-windows")
    done = jobs.drain(jobs.load_windows(samples, "6 hours", "1 hour"), out, checkpoint)
    return done.select(
        "run_id",
        F.unix_micros("start").alias("start_us"),
        F.round("loadavg_mean", 6).alias("loadavg_mean"),
        "cpu_busy_max",
        "samples",
    )


@query("i5_tripwire", over("measurements", body="""
    WITH m AS (SELECT class_id, toolchain, count(*) AS n, quantile_cont(cost_us, 0.5) AS median FROM meas GROUP BY 1, 2)
    SELECT m.class_id, m.toolchain, m.n, m.median, round(m.median / b.median, 6) AS ratio
    FROM m JOIN m b ON b.class_id = m.class_id AND b.toolchain = '1.71' WHERE m.median / b.median > 1.5"""))
def i5(spark, sf):
    seen = lens.measurements(spark, sf)
    base = exact_quantiles(seen.where("toolchain = '1.71'"), ["class_id"], "cost_us", {"base_median": 0.5}).drop("n")
    arriving = fresh_folder(spark, "observations")
    cols = seen.select("class_id", "toolchain", "cost_us")
    cols.repartition(2).write.parquet(arriving)
    out, checkpoint = folders(spark, "tripwire")
    jobs.tripwire(jobs.file_stream(spark, arriving, cols.schema, per_trigger=1), base, out, checkpoint, limit=1.5)
    return jobs.latest_alerts(spark, out).withColumn("ratio", F.round("ratio", 6))
