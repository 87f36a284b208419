"""Registered queries: flattening (C) and published SQL (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forgeclock.functions import coerce, ids
from forgeclock.operators import flatten, graph
from forgeclock.plans import lens, published, raw_lens
from forgeclock.plans.lens import over
from forgeclock.shared import materialise
from forgeclock.sources import lake

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


# ------------------------------------------------------------------ C: event log to units

_LIVES = """WITH reg AS (SELECT run_id, index, max(pos) AS rp FROM ev WHERE reason = 'unit-registered' GROUP BY 1, 2),
after AS (SELECT ev.*, rp FROM ev JOIN reg ON ev.run_id = reg.run_id AND ev.index = reg.index WHERE pos > rp),
starts AS (SELECT * FROM after WHERE reason = 'unit-started'),
finishes AS (SELECT * FROM after WHERE reason = 'unit-finished'),
timed AS (SELECT f.*, f.elapsed - s.elapsed AS took FROM finishes f
  ASOF LEFT JOIN starts s ON f.run_id = s.run_id AND f.index = s.index AND f.pos > s.pos),
opens AS (SELECT * FROM ev WHERE reason = 'unit-section-started' AND elapsed IS NOT NULL),
spans AS (SELECT f.run_id, f.index, f.section, f.pos, f.elapsed - o.elapsed AS span
  FROM (SELECT * FROM after WHERE reason = 'unit-section-finished' AND elapsed IS NOT NULL) f
  ASOF JOIN opens o ON f.run_id = o.run_id AND f.index = o.index AND f.section = o.section AND f.pos > o.pos),
st AS (SELECT run_id, index, arg_max_null(elapsed, pos) AS started FROM starts GROUP BY 1, 2),
fi AS (SELECT run_id, index, arg_max_null(elapsed, pos) AS finished, arg_max_null(len(unblocked), pos) AS unblocked
  FROM finishes GROUP BY 1, 2),
du AS (SELECT run_id, index, arg_max(took, pos) AS duration FROM timed WHERE took IS NOT NULL GROUP BY 1, 2),
se AS (SELECT run_id, index, sum(span) FILTER (WHERE section = 'codegen') AS codegen,
    sum(span) FILTER (WHERE section = 'link') AS link, sum(span) FILTER (WHERE section = 'frontend') AS measured
  FROM spans WHERE section IN ('codegen', 'link', 'frontend') GROUP BY 1, 2),
final AS (SELECT r.run_id, r.index, e.target_name AS crate, e.mode, e.package_id,
    CASE WHEN contains(e.package_id, '#') THEN
      nullif(split_part(regexp_extract(e.package_id, '[^#]*$'), '@', 1), '') END AS package,
    duration, started, finished, codegen, link,
    CASE WHEN se.run_id IS NOT NULL AND duration IS NOT NULL
      THEN duration - coalesce(codegen, 0) - coalesce(link, 0) ELSE measured END AS frontend,
    CAST(fi.unblocked AS BIGINT) AS unblocked
  FROM reg r JOIN ev e ON e.run_id = r.run_id AND e.pos = r.rp
  LEFT JOIN st ON st.run_id = r.run_id AND st.index = r.index
  LEFT JOIN fi ON fi.run_id = r.run_id AND fi.index = r.index
  LEFT JOIN du ON du.run_id = r.run_id AND du.index = r.index
  LEFT JOIN se ON se.run_id = r.run_id AND se.index = r.index)
"""


def _units_oracle(columns: str) -> str:
    return over("events", body=_LIVES + f"SELECT {columns} FROM final")


def _unit_query(name: str, columns: str):
    names = [c.strip() for c in columns.split(",")]
    QUERIES[name] = lambda spark, sf: flatten.unit_rows(lens.event_log(spark, sf), lens.EVENT_SEGMENT).select(*names)
    ORACLES[name] = _units_oracle(columns)


@query(
    "c1_package_name",
    over("events", body="""WITH ids AS (SELECT DISTINCT package_id AS id FROM ev WHERE package_id IS NOT NULL
      UNION SELECT url FROM pages UNION SELECT url || '#' || page_id || '.0' FROM pages
      UNION SELECT url || '#name@' || page_id FROM pages UNION SELECT url || '#' FROM pages)
    SELECT id, CASE WHEN contains(id, '#') THEN nullif(split_part(regexp_extract(id, '[^#]*$'), '@', 1), '') END AS package
    FROM ids"""),
)
def c1(spark, sf):
    url = lens.table(spark, sf, "pages").select(
        F.explode(
            F.array(
                F.col("url"),
                F.concat("url", F.lit("#"), "page_id", F.lit(".0")),
                F.concat("url", F.lit("#name@"), "page_id"),
                F.concat("url", F.lit("#")),
            )
        ).alias("id")
    )
    logged = lens.event_log(spark, sf).where("package_id IS NOT NULL").select(F.col("package_id").alias("id"))
    return url.union(logged).distinct().withColumn("package", ids.package_name(F.col("id")))


_unit_query("c2_unit_registration", "run_id, index, crate, package_id, package, mode")
_unit_query("c3_start_finish", "run_id, index, started, finished")
_unit_query("c4_duration", "run_id, index, duration")
_unit_query("c5_unblocked", "run_id, index, unblocked")


@query("c6_section_pairing", over("events", body=_LIVES + "SELECT run_id, index, section, pos, span FROM spans"))
def c6(spark, sf):
    return flatten.section_spans(lens.event_log(spark, sf), lens.EVENT_SEGMENT)


_unit_query("c7_section_sums", "run_id, index, codegen, link")
_unit_query("c8_frontend", "run_id, index, frontend")
_unit_query(
    "c9_units",
    "run_id, index, crate, package, mode, package_id, duration, started, finished, frontend, codegen, link, unblocked",
)


# ------------------------------------------------------------------ C: documents to tables


def read(spark, sf, *args, **kwargs):
    return lake.flattenable(raw_lens.documents(spark, sf), *args, **kwargs)


@query("c9_units_from_documents", """
    SELECT 'o' || o_orderkey AS run_id, i.index AS index, CASE i.index WHEN 0 THEN 'a' || (o_custkey % 50) ELSE 'b' END AS crate,
      CASE i.index WHEN 0 THEN 'a' || (o_custkey % 50) END AS package, 'build' AS mode,
      CASE i.index WHEN 0 THEN 'registry+https://github.com/rust-lang/crates.io-index#a' || (o_custkey % 50) || '@1.0.' || (o_custkey % 50)
        ELSE 'path+file:///x' END AS package_id,
      CASE i.index WHEN 0 THEN 5 + o_orderkey % 20 - 0.5::DOUBLE END AS duration,
      CASE i.index WHEN 0 THEN 0.5::DOUBLE END AS started,
      CASE i.index WHEN 0 THEN CAST(5 + o_orderkey % 20 AS DOUBLE) END AS finished,
      CASE i.index WHEN 0 THEN 5 + o_orderkey % 20 - 0.5::DOUBLE - (o_orderkey % 3 + 0.5::DOUBLE) END AS frontend,
      CASE i.index WHEN 0 THEN o_orderkey % 3 + 0.5::DOUBLE END AS codegen, CAST(NULL AS DOUBLE) AS link,
      CASE WHEN i.index = 0 AND o_orderkey % 2 = 0 THEN CAST(1 AS BIGINT) END AS unblocked
    FROM orders, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) AS i(index)
    WHERE i.index = 0 OR o_orderkey % 3 = 0""")
def c9_documents(spark, sf):
    events = flatten.event_rows(read(spark, sf, "events", head=("run_id", "first_pos")))
    return flatten.units_table(materialise(events, "events"))


@query("c10_sessions", """
    SELECT 'o' || o_orderkey AS run_id, 'sessions/o' || o_orderkey || '.json.zst' AS object_key,
      'client 0.' || (o_orderkey % 3) AS client, CAST(1 AS BIGINT) AS schema,
      strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS timestamp, '1.' || (70 + o_orderkey % 12) AS rustc_version,
      'dev' AS profile, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 8 ELSE o_orderkey % 16 END AS BIGINT) AS jobs,
      CASE o_orderkey % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 3 THEN true END AS ci,
      o_orderkey % 4 IN (0, 2) AS complete,
      CAST(CASE WHEN o_orderkey % 3 = 0 THEN 6 ELSE 5 END AS BIGINT) AS events,
      CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS units, CAST(NULL AS BIGINT) AS units_withheld,
      CAST(1 AS BIGINT) AS sections, 'm' || o_custkey AS machine_id, 'linux' AS os, CAST(NULL AS VARCHAR) AS arch,
      CAST(NULL AS VARCHAR) AS cpu_model, CAST(8 AS BIGINT) AS cpu_cores, CAST(o_custkey % 30 AS BIGINT) AS mem_gb,
      CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 8 + 0.5::DOUBLE END AS loadavg_mean,
      CASE WHEN o_custkey % 3 <> 1 THEN CAST(o_custkey % 100 AS DOUBLE) END AS cpu_busy_mean
    FROM orders""")
def c10(spark, sf):
    return flatten.sessions_table(materialise(read(spark, sf, head=flatten.SESSION_HEAD), "heads"))


_SAMPLED = """sampled AS (SELECT o_orderkey AS q, o_custkey AS c, 'o' || o_orderkey AS run_id, 'a' || (o_custkey % 50) AS crate,
      'a-1.0.' || (o_custkey % 50) AS package, 'lib' AS crate_type FROM orders WHERE o_orderkey % 6 <> 5)"""


@query("c11_phases", f"""WITH {_SAMPLED}, counts AS (
      SELECT *, 'serial' AS thread, 'type_check' AS phase, q % 40 AS samples FROM sampled
      UNION ALL SELECT *, 'serial', 'borrowck', c % 10 FROM sampled
      UNION ALL SELECT *, 'parallel', 'codegen', c % 9 FROM sampled WHERE q % 2 = 0)
    SELECT run_id, crate, package, crate_type, thread, phase, CAST(samples AS BIGINT) AS samples,
      q % 60 + 0.25::DOUBLE AS wall_s, CAST(4999 AS BIGINT) AS rate_hz, 'samply' AS sampler FROM counts""")
def c11(spark, sf):
    return flatten.phases_table(read(spark, sf, "sampled"))


@query("c12_timeline", """
    SELECT 'o' || o_orderkey AS run_id, 0.25::DOUBLE AS t, CAST(1 AS BIGINT) AS active, CAST(o_orderkey % 3 AS BIGINT) AS waiting,
      CAST(2 AS BIGINT) AS inactive, CAST(NULL AS DOUBLE) AS cpu_pct FROM orders WHERE o_orderkey % 5 <> 4
    UNION ALL SELECT 'o' || o_orderkey, 0.5, NULL, NULL, NULL, CAST(o_orderkey % 101 AS DOUBLE) FROM orders WHERE o_orderkey % 5 <> 4
    UNION ALL SELECT 'o' || o_orderkey, 1, NULL, NULL, NULL, CAST(o_custkey % 7 AS DOUBLE) FROM orders WHERE o_orderkey % 5 <> 4""")
def c12(spark, sf):
    return flatten.timeline_table(read(spark, sf, "timings"))


@query("c13_unit_flags", f"""WITH {_SAMPLED}
    SELECT run_id, crate, package, crate_type, f.flag AS flag, f.value AS value
    FROM sampled, LATERAL (VALUES ('opt-level', CAST(q % 4 AS VARCHAR)), ('lto', 'true'), ('level', CAST(q % 3 AS VARCHAR))) AS f(flag, value)""")
def c13(spark, sf):
    return flatten.unit_flags_table(read(spark, sf, "sampled"))


@query("c14_coercion", """
    SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN k % 6 = 4 OR k % 6 = 5 THEN NULL WHEN k % 6 = 3 THEN 0
        WHEN k % 6 = 2 THEN 1 ELSE value END::DOUBLE AS num,
      CAST(CASE WHEN k % 6 = 4 OR k % 6 = 5 THEN NULL WHEN k % 6 = 3 THEN 0
        WHEN k % 6 = 2 THEN 1 ELSE trunc(value) END AS BIGINT) AS int64,
      CASE k % 6 WHEN 3 THEN false WHEN 5 THEN NULL ELSE true END AS truth
    FROM (SELECT event_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""")
def c14(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    shape = (
        F.when(k % 6 == 0, F.concat(F.lit('{"x":'), F.col("value").cast("string"), F.lit("}")))
        .when(k % 6 == 1, F.concat(F.lit('{"x":"'), F.col("value").cast("string"), F.lit('"}')))
        .when(k % 6 == 2, F.lit('{"x":true}'))
        .when(k % 6 == 3, F.lit('{"x":""}'))
        .when(k % 6 == 4, F.lit('{"x":"Infinity"}'))
        .otherwise(F.lit('{"x":null}'))
    )
    v = F.col("v")
    docs = lens.table(spark, sf, "events").select("event_id", F.try_parse_json(shape).alias("v"))
    return docs.select(
        "event_id",
        coerce.number(v, "$.x").alias("num"),
        coerce.integer(v, "$.x").alias("int64"),
        coerce.truth(v, "$.x").alias("truth"),
    )


@query("c15_counts", over("events", body="""
    SELECT run_id, count(*) AS events, count(*) FILTER (WHERE reason = 'unit-registered') AS units,
      count(*) FILTER (WHERE reason = 'unit-section-finished') AS sections FROM ev GROUP BY run_id
    """.replace("\n", " ").strip()))
def c15(spark, sf):
    return flatten.event_counts(lens.event_log(spark, sf), "run_id").drop("complete")


@query("c16_completeness", over("events", body="""
    SELECT run_id, sum(CASE reason WHEN 'unit-finished' THEN 1 WHEN 'unit-registered' THEN -1 ELSE 0 END) = 0 AS complete
    FROM ev GROUP BY run_id"""))
def c16(spark, sf):
    return flatten.event_counts(lens.event_log(spark, sf), "run_id").select("run_id", "complete")


# ------------------------------------------------------------------ D: published SQL


def _published(name: str, text: str, lens_name: str, oracle: str):
    frame = getattr(lens, lens_name)
    QUERIES[name] = lambda spark, sf: published.run(spark, text, **{lens_name: frame(spark, sf)})
    ORACLES[name] = over(lens_name, body=oracle)


_published("d1_newest_sessions", "newest_sessions", "sessions",
           "SELECT run_id, timestamp, rustc_version, cpu_model, units, complete FROM sessions ORDER BY timestamp DESC")
_published("d2_slowest_units", "slowest_units", "units",
           "SELECT package, crate, mode, round(duration, 3) AS seconds FROM units "
           "ORDER BY duration DESC NULLS LAST, package, crate, mode LIMIT 20")
_published("d4_section_totals", "section_totals", "units",
           "SELECT package, round(sum(frontend), 3) AS frontend_seconds, round(sum(codegen), 3) AS codegen_seconds, "
           "round(sum(link), 3) AS link_seconds FROM units GROUP BY package "
           "ORDER BY frontend_seconds + codegen_seconds + link_seconds DESC NULLS LAST, package LIMIT 20")
_published("d5_most_unblocking", "most_unblocking", "units",
           "SELECT package, sum(unblocked)::BIGINT AS units_unblocked FROM units GROUP BY package "
           "ORDER BY units_unblocked DESC NULLS LAST, package LIMIT 20")
_published("d6_mean_cpu", "mean_cpu", "timeline",
           "SELECT run_id, round(avg(cpu_pct), 1) AS mean_cpu_pct FROM timeline WHERE cpu_pct IS NOT NULL GROUP BY run_id")
_published("d7_flag_census", "flag_census", "unit_flags",
           "SELECT flag, value, count(*) AS units FROM unit_flags GROUP BY flag, value")
_published("d8_phase_by_package", "phase_by_package", "phases",
           "SELECT package, phase, sum(samples)::BIGINT AS samples FROM phases WHERE thread = 'serial' GROUP BY 1, 2")
_published("d9_all_units", "all_units", "units", "SELECT * FROM units")


@query("d3_serial_phase_share", over("phases", body="""
    SELECT phase, sum(samples)::BIGINT AS samples,
      round(100.0::DOUBLE * sum(samples)::DOUBLE / sum(sum(samples)) OVER ()::DOUBLE, 1) AS share_pct
    FROM phases WHERE thread = 'serial' GROUP BY phase"""))
def d3(spark, sf):
    return published.serial_phase_share(lens.phases(spark, sf))


@query("d10_cone_total", over("graph", recursive=True, body="""
    WITH closure AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM closure c JOIN edges e ON c.dst = e.src)
    SELECT sum(l_quantity) AS cpu_s FROM closure JOIN graph ON src = node JOIN lineitem ON l_partkey = dst
    WHERE package = 'Brand#7'"""))
def d10(spark, sf):
    units = lens.graph_units(spark, sf)
    named = units.where("package = 'Brand#7'").select(F.col("node").alias("src"))
    cone = graph.cones(lens.graph_edges(spark, sf), sources=named)
    arrays = cone.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("cone_class_ids"))
    classes = arrays.join(units, arrays.src == units.node).select(F.col("package").alias("name"), "cone_class_ids")
    m = lens.table(spark, sf, "lineitem").selectExpr("l_partkey AS class_id", "l_quantity AS cpu_s")
    return spark.sql(published.SQL["cone_total"].replace("{name}", ":name"), args={"name": "Brand#7"}, classes=classes, measurements=m)
