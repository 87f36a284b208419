"""Lenses: the given tables seen as build-census data.

Each lens is one deterministic projection, written as a DataFrame here and as
DuckDB text in ``LENS_SQL``.  Queries run the library's operators on the
DataFrame; oracles compute the same answer from the text with plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --------------------------------------------------------------------------- event log
# Run = user, unit = k mod 8, order = event id (time order), elapsed in microseconds.

EVENT_SEGMENT = 65_536


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the build clock: k, and microseconds since the run's first event."""
    e = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    first = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    return e.join(first, "user_id").withColumn(
        "us", F.expr("timestampdiff(MICROSECOND, first_ts, ts)").cast("double")
    )


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    return clicks(spark, sf).selectExpr(
        "concat('u', user_id) AS object_key",
        "concat('u', user_id) AS run_id",
        "event_id AS pos",
        """CASE event_type WHEN 'signup' THEN 'unit-registered' WHEN 'view' THEN 'unit-started'
             WHEN 'purchase' THEN 'unit-finished' WHEN 'click' THEN 'unit-section-started'
             ELSE 'unit-section-finished' END AS reason""",
        "CAST(k % 8 AS BIGINT) AS index",
        "CASE WHEN k % 25 <> 7 THEN us END AS elapsed",
        """CASE WHEN event_type IN ('click', 'error') THEN
             CASE WHEN k >= 95 THEN 'incremental' WHEN k % 10 = 9 THEN 'frontend'
                  WHEN k % 2 = 0 THEN 'codegen' ELSE 'link' END END AS section""",
        """CASE WHEN event_type = 'signup' THEN CASE (k div 8) % 6
             WHEN 0 THEN concat('registry+https://github.com/rust-lang/crates.io-index#pkg', k div 8, '@1.', k % 8, '.0')
             WHEN 1 THEN concat('sparse+https://index.crates.io/#pkg', k div 8, '@2.0.', k % 8)
             WHEN 2 THEN concat('git+https://example.com/r', k div 8, '#0.', k % 8, '.0')
             WHEN 3 THEN concat('path+file:///home/dev/ws/crate', k div 8, '#0.1.', k % 8)
             WHEN 4 THEN concat('path+file:///home/dev/ws/dir', k div 8, '#crate', k div 8, '@0.2.', k % 8)
             ELSE concat('registry+https://private.example.com/index#secret', k div 8, '@9.0.0') END END AS package_id""",
        "CASE WHEN event_type = 'signup' THEN concat('pkg-', k div 8) END AS target_name",
        "CASE WHEN event_type = 'signup' THEN CASE WHEN k % 3 = 0 THEN 'run-custom-build' ELSE 'build' END END AS mode",
        "CASE WHEN event_type = 'signup' THEN array(bigint(k % 8), bigint((k + 3) % 8), bigint(k % 8)) END AS dependencies",
        "CASE WHEN event_type = 'purchase' AND k % 10 <> 9 THEN array(bigint((k + 1) % 8), bigint((k + 5) % 8)) END AS unblocked",
    )


_CLICKS_SQL = """clicks AS (
  SELECT event_id, user_id, event_type, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         CAST(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS DOUBLE) AS us
  FROM events)"""

_EVENTS_SQL = _CLICKS_SQL + """,
ev AS (
  SELECT 'u' || user_id AS run_id, event_id AS pos,
    CASE event_type WHEN 'signup' THEN 'unit-registered' WHEN 'view' THEN 'unit-started'
      WHEN 'purchase' THEN 'unit-finished' WHEN 'click' THEN 'unit-section-started'
      ELSE 'unit-section-finished' END AS reason,
    CAST(k % 8 AS BIGINT) AS index,
    CASE WHEN k % 25 <> 7 THEN us END AS elapsed,
    CASE WHEN event_type IN ('click', 'error') THEN
      CASE WHEN k >= 95 THEN 'incremental' WHEN k % 10 = 9 THEN 'frontend'
           WHEN k % 2 = 0 THEN 'codegen' ELSE 'link' END END AS section,
    CASE WHEN event_type = 'signup' THEN CASE (k // 8) % 6
      WHEN 0 THEN 'registry+https://github.com/rust-lang/crates.io-index#pkg' || (k // 8) || '@1.' || (k % 8) || '.0'
      WHEN 1 THEN 'sparse+https://index.crates.io/#pkg' || (k // 8) || '@2.0.' || (k % 8)
      WHEN 2 THEN 'git+https://example.com/r' || (k // 8) || '#0.' || (k % 8) || '.0'
      WHEN 3 THEN 'path+file:///home/dev/ws/crate' || (k // 8) || '#0.1.' || (k % 8)
      WHEN 4 THEN 'path+file:///home/dev/ws/dir' || (k // 8) || '#crate' || (k // 8) || '@0.2.' || (k % 8)
      ELSE 'registry+https://private.example.com/index#secret' || (k // 8) || '@9.0.0' END END AS package_id,
    CASE WHEN event_type = 'signup' THEN 'pkg-' || (k // 8) END AS target_name,
    CASE WHEN event_type = 'signup' THEN CASE WHEN k % 3 = 0 THEN 'run-custom-build' ELSE 'build' END END AS mode,
    CASE WHEN event_type = 'signup' THEN [k % 8, (k + 3) % 8, k % 8]::BIGINT[] END AS dependencies,
    CASE WHEN event_type = 'purchase' AND k % 10 <> 9 THEN [(k + 1) % 8, (k + 5) % 8]::BIGINT[] END AS unblocked,
    k, us, ts, user_id
  FROM clicks)"""

# --------------------------------------------------------------------------- units
# One lineitem = one unit of build l_orderkey; the part names package and crate.


def units(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    part = table(spark, sf, "part")
    return li.join(part, li.l_partkey == part.p_partkey).selectExpr(
        "concat('o', l_orderkey) AS run_id",
        "CAST(l_linenumber AS BIGINT) AS index",
        "replace(p_name, ' ', '-') AS crate",
        "replace(p_brand, '#', '') AS package",
        "l_returnflag AS mode",
        "concat('registry+https://github.com/rust-lang/crates.io-index#', replace(p_brand, '#', ''), '@1.0.', p_size) AS package_id",
        "l_extendedprice AS duration",
        "l_quantity AS started",
        "l_quantity + l_extendedprice AS finished",
        "CAST(l_quantity AS DOUBLE) AS frontend",
        "CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber * 2 AS DOUBLE) END AS codegen",
        "CASE WHEN p_brand <> 'Brand#13' THEN round(l_discount * 100, 0) END AS link",
        "CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS BIGINT) END AS unblocked",
    )


_UNITS_SQL = """units AS (
  SELECT 'o' || l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS index, replace(p_name, ' ', '-') AS crate,
    replace(p_brand, '#', '') AS package, l_returnflag AS mode,
    'registry+https://github.com/rust-lang/crates.io-index#' || replace(p_brand, '#', '') || '@1.0.' || p_size AS package_id,
    l_extendedprice AS duration, l_quantity AS started, l_quantity + l_extendedprice AS finished,
    CAST(l_quantity AS DOUBLE) AS frontend,
    CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber * 2 AS DOUBLE) END AS codegen,
    CASE WHEN p_brand <> 'Brand#13' THEN round(l_discount * 100, 0) END AS link,
    CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS BIGINT) END AS unblocked
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

# --------------------------------------------------------------------------- sessions
# One order = one build on the customer's machine.

_SESSION_COLUMNS = [
    "concat('o', o_orderkey) AS run_id",
    "concat('sessions/o', o_orderkey, '.json.zst') AS object_key",
    "concat('client 0.', o_orderkey % 3) AS client",
    "CAST(1 AS BIGINT) AS schema",
    "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00Z') AS timestamp",
    "concat('rustc 1.', 70 + o_orderkey % 12, '.0') AS rustc_version",
    "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'release' ELSE 'dev' END AS profile",
    "CAST(1 + o_orderkey % 16 AS BIGINT) AS jobs",
    "o_orderpriority IN ('1-URGENT', '5-LOW') AS ci",
    "o_orderstatus = 'F' AS complete",
    "CAST(o_orderkey % 500 AS BIGINT) AS events",
    "CAST(o_orderkey % 43 AS BIGINT) AS units",
    "CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 11 ELSE 0 END AS BIGINT) AS units_withheld",
    "CAST(o_orderkey % 68 AS BIGINT) AS sections",
    "CASE WHEN o_custkey % 10 <> 0 THEN concat('m', o_custkey) END AS machine_id",
    "CASE o_custkey % 3 WHEN 0 THEN 'linux' WHEN 1 THEN 'macos' ELSE 'windows' END AS os",
    "CASE WHEN o_custkey % 2 = 0 THEN 'x86_64' ELSE 'aarch64' END AS arch",
    "concat('cpu-', o_custkey % 7) AS cpu_model",
    "CAST(4 * (1 + o_custkey % 4) AS BIGINT) AS cpu_cores",
    "CAST(8 * (1 + o_custkey % 8) AS BIGINT) AS mem_gb",
    "CASE WHEN o_custkey % 3 <> 2 THEN CAST(o_orderkey % 160 AS DOUBLE) / 8 END AS loadavg_mean",
    "CAST(o_orderkey % 101 AS DOUBLE) AS cpu_busy_mean",
]


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*_SESSION_COLUMNS)


_SESSIONS_SQL = """sessions AS (
  SELECT 'o' || o_orderkey AS run_id, 'sessions/o' || o_orderkey || '.json.zst' AS object_key,
    'client 0.' || (o_orderkey % 3) AS client, CAST(1 AS BIGINT) AS schema,
    strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS timestamp,
    'rustc 1.' || (70 + o_orderkey % 12) || '.0' AS rustc_version,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'release' ELSE 'dev' END AS profile,
    CAST(1 + o_orderkey % 16 AS BIGINT) AS jobs,
    o_orderpriority IN ('1-URGENT', '5-LOW') AS ci, o_orderstatus = 'F' AS complete,
    CAST(o_orderkey % 500 AS BIGINT) AS events, CAST(o_orderkey % 43 AS BIGINT) AS units,
    CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 11 ELSE 0 END AS BIGINT) AS units_withheld,
    CAST(o_orderkey % 68 AS BIGINT) AS sections,
    CASE WHEN o_custkey % 10 <> 0 THEN 'm' || o_custkey END AS machine_id,
    CASE o_custkey % 3 WHEN 0 THEN 'linux' WHEN 1 THEN 'macos' ELSE 'windows' END AS os,
    CASE WHEN o_custkey % 2 = 0 THEN 'x86_64' ELSE 'aarch64' END AS arch,
    'cpu-' || (o_custkey % 7) AS cpu_model, CAST(4 * (1 + o_custkey % 4) AS BIGINT) AS cpu_cores,
    CAST(8 * (1 + o_custkey % 8) AS BIGINT) AS mem_gb,
    CASE WHEN o_custkey % 3 <> 2 THEN CAST(o_orderkey % 160 AS DOUBLE) / 8 END AS loadavg_mean,
    CAST(o_orderkey % 101 AS DOUBLE) AS cpu_busy_mean
  FROM orders)"""

# --------------------------------------------------------------------------- phases
# One lineitem = one phase count of the unit (build, part).

# The phase names of the published tables.
_PHASE_LIST = (
    "'macro_expand', 'resolve', 'type_check', 'borrowck', 'coherence', 'monomorphize', "
    "'metadata_encode', 'codegen', 'unattributed', 'blocked'"
)


def phases(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    part = table(spark, sf, "part")
    return li.join(part, li.l_partkey == part.p_partkey).selectExpr(
        "concat('o', l_orderkey) AS run_id",
        "replace(p_name, ' ', '_') AS crate",
        "concat(replace(p_brand, '#', ''), '-1.0.', p_size) AS package",
        "CASE WHEN l_returnflag = 'R' THEN 'bin' ELSE 'lib' END AS crate_type",
        "CASE WHEN l_linenumber % 3 = 0 THEN 'parallel' ELSE 'serial' END AS thread",
        f"element_at(array({_PHASE_LIST}), CAST(1 + (l_partkey + l_suppkey) % 10 AS INT)) AS phase",
        "CAST(l_quantity AS BIGINT) AS samples",
        "CASE WHEN l_linenumber <> 5 THEN l_quantity / 4096 END AS wall_s",
        "CAST(4096 AS BIGINT) AS rate_hz",
        "'samply' AS sampler",
    )


_PHASES_SQL = f"""phases AS (
  SELECT 'o' || l_orderkey AS run_id, replace(p_name, ' ', '_') AS crate, replace(p_brand, '#', '') || '-1.0.' || p_size AS package,
    CASE WHEN l_returnflag = 'R' THEN 'bin' ELSE 'lib' END AS crate_type,
    CASE WHEN l_linenumber % 3 = 0 THEN 'parallel' ELSE 'serial' END AS thread,
    [{_PHASE_LIST}][1 + (l_partkey + l_suppkey) % 10] AS phase,
    CAST(l_quantity AS BIGINT) AS samples,
    CASE WHEN l_linenumber <> 5 THEN l_quantity / 4096 END AS wall_s,
    CAST(4096 AS BIGINT) AS rate_hz, 'samply' AS sampler
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

# --------------------------------------------------------------------------- timeline


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return clicks(spark, sf).selectExpr(
        "concat('u', user_id) AS run_id",
        "us / 1000000 AS t",
        "CASE WHEN k % 2 = 1 THEN CAST(k % 8 AS BIGINT) END AS active",
        "CASE WHEN k % 2 = 1 THEN CAST(k % 5 AS BIGINT) END AS waiting",
        "CASE WHEN k % 2 = 1 THEN CAST(k AS BIGINT) END AS inactive",
        "CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) END AS cpu_pct",
    )


_TIMELINE_SQL = _CLICKS_SQL + """,
timeline AS (
  SELECT 'u' || user_id AS run_id, us / 1000000 AS t,
    CASE WHEN k % 2 = 1 THEN CAST(k % 8 AS BIGINT) END AS active,
    CASE WHEN k % 2 = 1 THEN CAST(k % 5 AS BIGINT) END AS waiting,
    CASE WHEN k % 2 = 1 THEN CAST(k AS BIGINT) END AS inactive,
    CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) END AS cpu_pct
  FROM clicks)"""

# --------------------------------------------------------------------------- flags
# One lineitem = one sampled unit; five settings each, from its part.


def unit_flags(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = table(spark, sf, "part")
    return li.join(part, li.l_partkey == part.p_partkey).selectExpr(
        "concat('o', l_orderkey) AS run_id",
        "replace(p_name, ' ', '_') AS crate",
        "concat(replace(p_brand, '#', ''), '-1.0.', p_size) AS package",
        "'lib' AS crate_type",
        """stack(5, 'opt-level', CAST(p_size % 4 AS STRING), 'codegen-units', CAST(16 * (1 + p_size % 16) AS STRING),
             'lto', CASE p_type WHEN 'PROMO' THEN 'fat' WHEN 'SMALL' THEN 'thin' ELSE 'off' END,
             'features', lower(replace(p_name, ' ', ',')),
             'incremental', CASE WHEN p_partkey % 10 = 0 THEN 'true' END) AS (flag, value)""",
    ).where("value IS NOT NULL")


_FLAGS_SQL = """unit_flags AS (
  SELECT 'o' || l_orderkey AS run_id, replace(p_name, ' ', '_') AS crate, replace(p_brand, '#', '') || '-1.0.' || p_size AS package,
    'lib' AS crate_type, f.flag AS flag, f.value AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey,
    LATERAL (VALUES ('opt-level', CAST(p_size % 4 AS VARCHAR)),
      ('codegen-units', CAST(16 * (1 + p_size % 16) AS VARCHAR)),
      ('lto', CASE p_type WHEN 'PROMO' THEN 'fat' WHEN 'SMALL' THEN 'thin' ELSE 'off' END),
      ('features', lower(replace(p_name, ' ', ','))),
      ('incremental', CASE WHEN p_partkey % 10 = 0 THEN 'true' END)) AS f(flag, value)
  WHERE f.value IS NOT NULL)"""

# --------------------------------------------------------------------------- class graph
# Parts are units of one graph; part p depends on p/2 and p/3.


def graph_units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS node",
        "p_brand AS package",
        "concat('1.', p_size) AS version",
        "'registry' AS source",
        "lower(replace(p_name, ' ', ',')) AS features",
        "CASE WHEN p_partkey % 2 = 0 THEN 'dev' ELSE 'release' END AS profile",
        "'' AS rustflags",
        "p_type AS target",
        "CAST(round(p_retailprice * 100) AS BIGINT) AS cost",
        "filter(array(p_partkey div 2, p_partkey div 3), d -> d < p_partkey) AS dependencies",
    )


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph_units(spark, sf).selectExpr("node AS src", "explode(array_distinct(dependencies)) AS dst")


_GRAPH_SQL = """graph AS (
  SELECT p_partkey AS node, p_brand AS package, '1.' || p_size AS version, 'registry' AS source,
    lower(replace(p_name, ' ', ',')) AS features,
    CASE WHEN p_partkey % 2 = 0 THEN 'dev' ELSE 'release' END AS profile, '' AS rustflags, p_type AS target,
    CAST(round(p_retailprice * 100) AS BIGINT) AS cost
  FROM part),
edges AS (
  SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0
  UNION
  SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey > 0)"""

# --------------------------------------------------------------------------- observations
# One lineitem = one measurement of class l_partkey on machine l_suppkey.


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_partkey AS class_id",
        "l_suppkey AS machine_id",
        "concat('1.', 70 + l_linenumber) AS toolchain",
        "date_format(l_shipdate, 'yyyy-MM-dd') AS observed_at",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS cost_us",
        "CAST(l_quantity AS BIGINT) AS load",
    )


_MEASURE_SQL = """meas AS (
  SELECT l_partkey AS class_id, l_suppkey AS machine_id, '1.' || (70 + l_linenumber) AS toolchain,
    strftime(l_shipdate, '%Y-%m-%d') AS observed_at, CAST(round(l_extendedprice * 100) AS BIGINT) AS cost_us,
    CAST(l_quantity AS BIGINT) AS load
  FROM lineitem)"""

# --------------------------------------------------------------------------- profiles
# Orders form call trees (parent = half), lineitems are samples, customers are symbols.

# Symbol names with known phases, and some without.
_SYMBOL_LIST = (
    "'rustc_expand::mbe::expand', 'rustc_resolve::late', 'rustc_hir_analysis::coherence::orphan', "
    "'rustc_hir_typeck::check', 'rustc_borrowck::mir_borrowck', 'rustc_mir_transform::run_passes', "
    "'rustc_monomorphize::collector', 'rustc_metadata::rmeta::encoder', 'rustc_codegen_llvm::back', "
    "'std::vec::Vec::push', 'alloc::raw_vec', 'core::fmt', 'rustc_trait_selection::solve', "
    "'futex_wait', '__GI___poll', 'main', 'llvm::runPasses'"
)
_N_SYMBOLS = 17


def stack_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "concat('p', o_orderkey div 2048) AS profile_id",
        "CAST(o_orderkey % 4 AS INT) AS thread_pos",
        "CAST((o_orderkey % 2048) div 4 AS INT) AS node",
        "CASE WHEN (o_orderkey % 2048) div 4 > 0 THEN CAST((o_orderkey % 2048) div 8 AS INT) END AS prefix",
        "o_custkey * 64 + o_orderkey % 97 - 40 AS addr",
        "concat('lib', o_custkey % 3) AS lib",
    )


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "concat('lib', c_custkey % 3) AS lib",
        "c_custkey * 64 AS rva",
        f"element_at(array({_SYMBOL_LIST}), CAST(1 + c_custkey % {_N_SYMBOLS} AS INT)) AS symbol",
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "concat('p', l_orderkey div 2048) AS profile_id",
        "CAST(l_orderkey % 4 AS INT) AS thread_pos",
        "CASE WHEN l_linenumber <> 7 THEN CAST((l_orderkey % 2048) div 4 AS INT) END AS stack",
    )


def threads(spark: SparkSession, sf: str) -> DataFrame:
    """Threads of the profiles: two crates per profile, two threads each."""
    grouped = table(spark, sf, "orders").selectExpr("o_orderkey div 2048 AS p", "CAST(o_orderkey % 4 AS INT) AS t")
    return grouped.distinct().selectExpr(
        "concat('p', p) AS profile_id",
        "t AS thread_pos",
        """CASE WHEN p % 5 = 4 AND t = 3 THEN 'rustc --print target-libdir --crate-name probe -'
             WHEN p % 5 = 3 AND t >= 2 THEN concat('/work/out/release/build/crate-', p, '/build-script-build --jobs=', p)
             WHEN t < 2 THEN concat('rustc --crate-name crate_', p, ' ''--edition=2021'' /work/.cargo/registry/src/idx/crate-',
               p, '-1.0.', p, '/src/lib.rs --crate-type lib -C opt-level=', p % 4, ' -C ''metadata=h', p,
               ''' --cfg ''feature="net"'' --cfg ''feature="async"'' -C incremental=/work/inc')
             ELSE concat('rustc --crate-name build_script_build src/build.rs --crate-type bin -Cdebuginfo=2 -C metadata=b', p) END AS process_name""",
        "CASE t WHEN 0 THEN 'rustc' WHEN 1 THEN 'opt cgu.00' WHEN 2 THEN 'coordinator' ELSE 'main' END AS name",
        "CASE WHEN t <> 1 THEN CAST(1000 + t AS DOUBLE) END AS startup_ms",
        "CASE WHEN p % 7 <> 6 THEN CAST(1500 + 2 * t + p AS DOUBLE) END AS shutdown_ms",
    )


_PROFILE_SQL = f"""nodes AS (
  SELECT 'p' || (o_orderkey // 2048) AS profile_id, CAST(o_orderkey % 4 AS INTEGER) AS thread_pos,
    CAST((o_orderkey % 2048) // 4 AS INTEGER) AS node,
    CASE WHEN (o_orderkey % 2048) // 4 > 0 THEN CAST((o_orderkey % 2048) // 8 AS INTEGER) END AS prefix,
    o_custkey * 64 + o_orderkey % 97 - 40 AS addr, 'lib' || (o_custkey % 3) AS lib
  FROM orders),
symbols AS (
  SELECT 'lib' || (c_custkey % 3) AS lib, c_custkey * 64 AS rva, [{_SYMBOL_LIST}][1 + c_custkey % {_N_SYMBOLS}] AS symbol
  FROM customer),
samples AS (
  SELECT 'p' || (l_orderkey // 2048) AS profile_id, CAST(l_orderkey % 4 AS INTEGER) AS thread_pos,
    CASE WHEN l_linenumber <> 7 THEN CAST((l_orderkey % 2048) // 4 AS INTEGER) END AS stack
  FROM lineitem),
threads AS (
  SELECT 'p' || p AS profile_id, t AS thread_pos,
    CASE WHEN p % 5 = 4 AND t = 3 THEN 'probe' WHEN p % 5 = 3 AND t >= 2 THEN 'script' WHEN t < 2 THEN 'crate_' || p ELSE 'build_script_build' END AS crate,
    CASE WHEN t < 2 THEN 'crate-' || p || '-1.0.' || p ELSE 'build_script_build' END AS package,
    CASE WHEN t < 2 THEN 'lib' ELSE 'bin' END AS crate_type,
    CASE WHEN t < 2 THEN 'h' || p ELSE 'b' || p END AS unit_hash,
    CASE t WHEN 0 THEN 'rustc' WHEN 1 THEN 'opt cgu.00' WHEN 2 THEN 'coordinator' ELSE 'main' END AS name,
    CASE WHEN t IN (1, 2) THEN 'parallel' ELSE 'serial' END AS thread,
    CASE WHEN t <> 1 THEN CAST(1000 + t AS DOUBLE) END AS startup_ms,
    CASE WHEN p % 7 <> 6 THEN CAST(1500 + 2 * t + p AS DOUBLE) END AS shutdown_ms, p, t
  FROM (SELECT DISTINCT o_orderkey // 2048 AS p, CAST(o_orderkey % 4 AS INTEGER) AS t FROM orders))"""

LENS_SQL = {
    "clicks": _CLICKS_SQL,
    "events": _EVENTS_SQL,
    "units": _UNITS_SQL,
    "sessions": _SESSIONS_SQL,
    "phases": _PHASES_SQL,
    "timeline": _TIMELINE_SQL,
    "unit_flags": _FLAGS_SQL,
    "graph": _GRAPH_SQL,
    "measurements": _MEASURE_SQL,
    "profile": _PROFILE_SQL,
}


def over(*names: str, body: str, recursive: bool = False) -> str:
    """Oracle text: the named lenses as CTEs in front of ``body``.

    ``body`` starts with SELECT, or with ``WITH`` CTEs of its own.
    """
    ctes = ",\n".join(LENS_SQL[n] for n in names)
    body = body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("WITH "):
        return f"{head}{ctes},\n{body[5:]}"
    return f"{head}{ctes}\n{body}"
