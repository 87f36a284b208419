"""Registered queries: profile attribution (E), configuration (F), reports (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forgeclock.functions import coerce, flags, symbols
from forgeclock.operators import config, profile, reports
from forgeclock.plans import lens
from forgeclock.plans.lens import over, table
from forgeclock.shared import materialise

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


# ------------------------------------------------------------------ E: profile attribution

_MARK = """CASE WHEN contains(symbol, 'rustc_expand::') THEN 'macro_expand' WHEN contains(symbol, 'rustc_resolve::') THEN 'resolve'
    WHEN contains(symbol, 'rustc_hir_analysis::coherence') THEN 'coherence'
    WHEN contains(symbol, 'rustc_hir_analysis::') OR contains(symbol, 'rustc_hir_typeck::') THEN 'type_check'
    WHEN contains(symbol, 'rustc_borrowck::') OR contains(symbol, 'rustc_mir_transform::') THEN 'borrowck'
    WHEN contains(symbol, 'rustc_monomorphize::') THEN 'monomorphize'
    WHEN contains(symbol, 'rustc_metadata::rmeta::encoder') OR contains(symbol, 'encode_metadata') THEN 'metadata_encode'
    WHEN contains(symbol, 'rustc_codegen_llvm::') OR contains(symbol, 'rustc_codegen_ssa::') THEN 'codegen' END"""
_WAIT = r"regexp_matches(symbol, '(semaphore_wait_trap|__psynch_cvwait|__ulock_wait|kevent|__wait4|mach_msg2_trap|poll|epoll_wait|futex_wait)$')"

_TREE = f"""WITH named AS (SELECT n.*, s.symbol FROM nodes n ASOF LEFT JOIN symbols s ON n.lib = s.lib AND n.addr >= s.rva),
marked AS (SELECT *, {_MARK} AS mk, CASE WHEN symbol IS NOT NULL THEN {_WAIT} END AS w,
    coalesce(contains(symbol, 'rustc_trait_selection'), false) AS tr FROM named),
tree AS (SELECT profile_id, thread_pos, node, mk AS phase, w AS parked, tr AS traits FROM marked WHERE prefix IS NULL
  UNION ALL SELECT m.profile_id, m.thread_pos, m.node, coalesce(t.phase, m.mk), coalesce(m.w, t.parked), m.tr OR t.traits
  FROM marked m JOIN tree t ON m.profile_id = t.profile_id AND m.thread_pos = t.thread_pos AND m.prefix = t.node),
hits AS (SELECT s.profile_id, crate, package, crate_type, unit_hash, thread, name, traits,
    CASE WHEN parked THEN 'blocked' ELSE coalesce(phase, 'unattributed') END AS phase
  FROM samples s JOIN tree t ON s.profile_id = t.profile_id AND s.thread_pos = t.thread_pos AND s.stack = t.node
  JOIN threads h ON h.profile_id = s.profile_id AND h.thread_pos = s.thread_pos WHERE crate NOT IN ('probe', 'script'))
"""


def _tree(body: str) -> str:
    return over("profile", recursive=True, body=_TREE + body)


def node_facts(spark, sf):
    return profile.path_facts(profile.named_nodes(lens.stack_nodes(spark, sf), lens.symbols(spark, sf)))


def hits(spark, sf):
    return profile.attributed(
        lens.samples(spark, sf), node_facts(spark, sf), profile.unit_threads(lens.threads(spark, sf))
    )


@query("e1_compile_processes", over("profile", body="""
    SELECT profile_id, thread_pos, crate NOT IN ('probe', 'script') AS compile FROM threads"""))
def e1(spark, sf):
    args = flags.tokens(F.col("process_name"))
    return lens.threads(spark, sf).select(
        "profile_id", "thread_pos", flags.is_compile(F.col("process_name"), args).alias("compile")
    )


@query("e2_tokenise", """WITH line AS (SELECT doc_id, translate(text, '''', ' ') AS t, source FROM documents),
    whole AS (SELECT doc_id, list_filter(string_split_regex(t, '[\\s\\x{00A0}\\x{0085}\\x{000B}]+'), lambda x: x <> '') AS w, source FROM line)
    SELECT doc_id, CAST(len(w) + 1 AS BIGINT) AS n, array_to_string(w || ['x y' || source || 'z'], '|') AS args FROM whole""")
def e2(spark, sf):
    text = F.translate("text", "'", " ")
    line = F.concat(text, F.lit(" 'x y'"), "source", F.lit("'z' ''"))
    args = flags.tokens(line)
    return table(spark, sf, "documents").select(
        "doc_id", F.size(args).cast("bigint").alias("n"), F.array_join(args, "|").alias("args")
    )


@query("e3_unit_identity", over("profile", body="""
    SELECT DISTINCT profile_id, crate, crate_type, unit_hash, package FROM threads WHERE crate NOT IN ('probe', 'script')"""))
def e3(spark, sf):
    units = profile.unit_threads(lens.threads(spark, sf))
    return units.select("profile_id", "crate", "crate_type", "unit_hash", "package").distinct()


@query("e4_source_package", """SELECT page_id, 'c' || page_id AS crate,
      CASE WHEN page_id % 3 = 0 THEN 'pkg-' || regexp_extract(url, '//([^/]+)', 1) WHEN page_id % 3 = 1 THEN 'c' || page_id
        ELSE 'c' || page_id END AS package FROM pages""")
def e4(spark, sf):
    host = F.regexp_extract("url", "//([^/]+)", 1)
    source = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/h/registry/src/idx-1/pkg-"), host, F.lit("/src/lib.rs /h/registry/src/i/no-1/a.rs")))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("src/"), host, F.lit(".rs")))
        .otherwise(F.lit("/h/registry/src/lib.rs"))
    )
    line = F.concat(F.lit("rustc --crate-name=c"), "page_id", F.lit(" "), source)
    args = flags.tokens(line)
    return table(spark, sf, "pages").select(
        "page_id", flags.crate_name(args).alias("crate"), flags.source_package(args).alias("package")
    )


@query("e5_flag_extraction", """SELECT p_partkey, k AS flag, v AS value FROM part, LATERAL (VALUES
      ('codegen-units', CAST(p_size AS VARCHAR)), ('debuginfo', CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size % 3 AS VARCHAR) END),
      ('edition', CASE WHEN p_partkey % 4 <> 1 THEN '2021' END), ('features', (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM unnest(string_split(p_name || ' ' || p_type, ' ')) AS u(x))),
      ('incremental', CASE WHEN p_partkey % 5 = 0 THEN 'true' END), ('opt-level', CAST(p_size % 4 AS VARCHAR)),
      ('target', CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_type END)) AS f(k, v) WHERE v IS NOT NULL""")
def e5(spark, sf):
    line = F.expr("""concat('rustc --crate-name x src/lib.rs -C opt-level=9 -C ''opt-level=', p_size % 4, ''' -Ccodegen-units=', p_size,
        IF(p_partkey % 2 = 0, concat(' -C debuginfo=', p_size % 3), ''), IF(p_partkey % 4 <> 1, ' ''--edition=2021''', ''),
        IF(p_partkey % 5 = 0, ' -C incremental=/home/u/t', ''), ' -C metadata=abc -C extra-filename=-abc --out-dir /home/u',
        CASE p_partkey % 3 WHEN 0 THEN concat(' --target ', p_brand) WHEN 1 THEN concat(' --target=', p_type) ELSE '' END,
        array_join(transform(split(concat(p_name, ' ', p_type, ' ', p_name), ' '), x -> concat(' --cfg ''feature="', x, '"''')), ''))""")
    facts = table(spark, sf, "part").select("p_partkey", F.inline(flags.compile_facts(line)))
    return facts.select("p_partkey", F.explode("settings").alias("flag", "value"))


@query("e6_thread_class", """SELECT c_custkey, name, CASE WHEN c_custkey % 7 IN (0, 1, 2) THEN 'parallel' ELSE 'serial' END AS thread FROM
    (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'opt cgu.' || c_custkey WHEN 1 THEN 'codegen cgu.' || c_custkey WHEN 2 THEN 'coordinator'
      WHEN 3 THEN 'coordinator2' WHEN 4 THEN 'my opt cgu.1' WHEN 5 THEN NULL ELSE c_name END AS name FROM customer)""")
def e6(spark, sf):
    named = table(spark, sf, "customer").selectExpr("c_custkey", """CASE c_custkey % 7 WHEN 0 THEN concat('opt cgu.', c_custkey)
        WHEN 1 THEN concat('codegen cgu.', c_custkey) WHEN 2 THEN 'coordinator' WHEN 3 THEN 'coordinator2'
        WHEN 4 THEN 'my opt cgu.1' WHEN 5 THEN NULL ELSE c_name END AS name""")
    return named.withColumn("thread", symbols.thread_class(F.col("name")))


@query("e7_unit_wall", over("profile", body="""
    SELECT profile_id, crate, unit_hash, arg_min(round((shutdown_ms - startup_ms) / 1000 * 1e6) / 1e6, thread_pos)
      FILTER (WHERE shutdown_ms > startup_ms) AS wall_s
    FROM threads WHERE crate NOT IN ('probe', 'script') GROUP BY 1, 2, 3"""))
def e7(spark, sf):
    walls = profile.unit_walls(profile.unit_threads(lens.threads(spark, sf)))
    return walls.select("profile_id", "crate", "unit_hash", "wall_s")


@query("e8_symbol_resolution", over("profile", body="""
    SELECT DISTINCT n.lib, n.addr, s.symbol FROM nodes n ASOF LEFT JOIN symbols s ON n.lib = s.lib AND n.addr >= s.rva"""))
def e8(spark, sf):
    return profile.resolve_symbols(lens.stack_nodes(spark, sf), lens.symbols(spark, sf))


@query("e8_latest_order", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, at_us, o_orderkey AS latest FROM
    (SELECT l.*, o.o_custkey AS cust, epoch_us(l_shipdate) AS at_us FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey) a
    LEFT JOIN LATERAL (SELECT 1) ON true ASOF LEFT JOIN (SELECT o_custkey, epoch_us(o_orderdate) AS t, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) b
    ON a.cust = b.o_custkey AND a.at_us >= b.t""".replace("LEFT JOIN LATERAL (SELECT 1) ON true ", ""))
def e8_orders(spark, sf):
    """The as-of operator on plain rows: a customer's latest order at or before each shipment."""
    from forgeclock.operators.ordered import running_last

    us = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})")
    o = table(spark, sf, "orders")
    known = o.groupBy(F.col("o_custkey").alias("cust"), us("o_orderdate").alias("at_us")).agg(
        F.max("o_orderkey").alias("order")
    )
    li = table(spark, sf, "lineitem").join(o.select("o_orderkey", F.col("o_custkey").alias("cust")), F.col("l_orderkey") == F.col("o_orderkey"))
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    asked = li.select("cust", us("l_shipdate").alias("at_us"), *cols).withColumn("probe", F.lit(1))
    both = asked.unionByName(known.withColumn("probe", F.lit(0)), allowMissingColumns=True).withColumn(
        "at", F.col("at_us") * 2 + F.col("probe")
    )
    month = F.lit(30 * 86_400_000_000)
    found = running_last(both, ["cust"], "at", {"latest": F.col("order")}, F.floor(F.col("at_us") / month))
    return found.where("probe = 1").select(*cols, "at_us", "latest")


@query("e9_phase_markers", over("profile", body=f"SELECT lib, rva, symbol, {_MARK} AS phase, {_WAIT} AS waits FROM symbols"))
def e9(spark, sf):
    s = F.col("symbol")
    return lens.symbols(spark, sf).select(
        "lib", "rva", "symbol", symbols.phase_marker(s).alias("phase"), symbols.is_wait(s).alias("waits")
    )


@query("e10_outermost_phase", _tree("SELECT profile_id, thread_pos, node, phase FROM tree"))
def e10(spark, sf):
    return node_facts(spark, sf).select("profile_id", "thread_pos", "node", "phase")


@query("e11_blocked_override", _tree("SELECT profile_id, thread_pos, node, CASE WHEN parked THEN 'blocked' ELSE coalesce(phase, 'unattributed') END AS phase FROM tree"))
def e11(spark, sf):
    return node_facts(spark, sf).select("profile_id", "thread_pos", "node", profile.sample_phase().alias("phase"))


_U = "profile_id, crate, crate_type, unit_hash, package"


@query("e12_phase_counts", _tree(f"SELECT {_U}, thread, phase, count(*) AS samples FROM hits GROUP BY ALL"))
def e12(spark, sf):
    return profile.phase_counts(hits(spark, sf)).drop("flags")


@query("e13_unit_order", _tree(f"SELECT {_U}, count(*) AS samples FROM hits GROUP BY ALL HAVING count(*) > 0 ORDER BY samples DESC"))
def e13(spark, sf):
    return profile.unit_totals(profile.phase_counts(hits(spark, sf))).drop("flags")


@query("e14_phases_documents", _tree("""
    SELECT profile_id, 'samply' AS sampler, CAST(4999 AS BIGINT) AS rate_hz, crate, phase, thread, count(*) AS samples
    FROM hits GROUP BY ALL"""))
def e14(spark, sf):
    """The documents read back: two maps per unit, exploded again."""
    h = hits(spark, sf)
    walls = profile.unit_walls(profile.unit_threads(lens.threads(spark, sf)))
    docs = profile.phases_documents(profile.phase_counts(h), walls, 4999, "samply")
    u = F.col("u")

    def side(thread):
        return F.transform(
            F.coalesce(coerce.entries(u, f"$.{thread}"), F.array().cast("array<struct<key:string,value:variant>>")),
            lambda e: F.struct(
                F.lit(thread).alias("thread"), e["key"].alias("phase"), coerce.integer(e["value"]).alias("samples")
            ),
        )

    both = F.concat(side("serial"), side("parallel"))
    return docs.select("profile_id", "sampler", "rate_hz", F.parse_json("unit").alias("u")).select(
        "profile_id", "sampler", "rate_hz", coerce.text(u, "$.crate").alias("crate"), F.inline(both)
    )


@query("e15_codegen_units", _tree(f"SELECT {_U}, name AS codegen_unit, count(*) AS samples FROM hits WHERE starts_with(name, 'opt cgu') GROUP BY ALL"))
def e15(spark, sf):
    return profile.codegen_units(hits(spark, sf)).drop("flags")


@query("e15_codegen_unit_counts", _tree(f"SELECT {_U}, count(DISTINCT name) AS codegen_units FROM hits WHERE starts_with(name, 'opt cgu') GROUP BY ALL"))
def e15_counts(spark, sf):
    return profile.codegen_unit_counts(hits(spark, sf)).drop("flags")


@query("e16_trait_cost", _tree(f"SELECT {_U}, thread, count(*) FILTER (WHERE traits) AS trait_samples, count(*) AS samples FROM hits GROUP BY ALL"))
def e16(spark, sf):
    return profile.trait_cost(hits(spark, sf)).drop("flags")


@query("e17_build_scripts", over("profile", body="""
    SELECT profile_id, round((max(shutdown_ms) - min(startup_ms)) * 1000) / 1e6 AS wall_s FROM threads WHERE crate = 'script' GROUP BY 1"""))
def e17(spark, sf):
    return profile.build_script_runs(lens.threads(spark, sf)).drop("process_name")


# ------------------------------------------------------------------ F: machine, load, configuration

_HOST = """host AS (SELECT 'u' || user_id AS run_id, user_id, event_id, ts, CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE k / 4.0 END::DOUBLE AS loadavg,
      CAST(k AS DOUBLE) AS cpu_pct, CASE WHEN user_id % 7 <> 0 OR k % 3 <> 0 THEN event_id * 1000 + k END AS psi_cpu,
      CASE WHEN user_id % 2 = 0 THEN 1000000000 - event_id * 10 ELSE event_id * 10 END AS psi_io, CASE WHEN user_id % 3 <> 0 THEN event_id * event_id END AS psi_memory FROM clicks)"""


def host_samples(spark, sf):
    return lens.clicks(spark, sf).selectExpr(
        "concat('u', user_id) AS run_id",
        "ts",
        "CASE WHEN user_id % 5 = 0 THEN 0.0D ELSE k / 4.0D END AS loadavg",
        "CAST(k AS DOUBLE) AS cpu_pct",
        "CASE WHEN user_id % 7 <> 0 OR k % 3 <> 0 THEN event_id * 1000 + k END AS psi_cpu",
        "CASE WHEN user_id % 2 = 0 THEN 1000000000 - event_id * 10 ELSE event_id * 10 END AS psi_io",
        "CASE WHEN user_id % 3 <> 0 THEN event_id * event_id END AS psi_memory",
    )


@query("f1_load_summary", over("clicks", body=f"""WITH {_HOST}
    SELECT run_id, CASE WHEN max(loadavg) > 0 THEN round(avg(loadavg), 6) END AS loadavg_mean,
      CASE WHEN max(loadavg) > 0 THEN max(loadavg) END AS loadavg_max, round(avg(cpu_pct), 6) AS cpu_busy_mean,
      max(cpu_pct) AS cpu_busy_max, count(*) AS samples FROM host GROUP BY run_id"""))
def f1(spark, sf):
    out = config.load_summary(host_samples(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("loadavg_mean", "cpu_busy_mean")})


@query("f2_stall_seconds", over("clicks", body=f"""WITH {_HOST},
    ends AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts) AS a, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC) AS z FROM host)
    SELECT f.run_id, CASE WHEN l.psi_cpu - f.psi_cpu < 0 THEN 0 ELSE (l.psi_cpu - f.psi_cpu) / 1e6 END AS cpu,
      CASE WHEN l.psi_io - f.psi_io < 0 THEN 0 ELSE (l.psi_io - f.psi_io) / 1e6 END AS io,
      CASE WHEN l.psi_memory - f.psi_memory < 0 THEN 0 ELSE (l.psi_memory - f.psi_memory) / 1e6 END AS memory
    FROM ends f JOIN ends l ON f.run_id = l.run_id AND f.a = 1 AND l.z = 1"""))
def f2(spark, sf):
    return config.stall_seconds(host_samples(spark, sf))


@query("f3_machine_id", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'env' || c_custkey
      WHEN c_custkey % 5 = 2 THEN NULL WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN c_mktsegment
      WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN NULL ELSE c_name END AS machine_id FROM customer""")
def f3(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        config.machine_id(
            F.expr("CASE c_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN concat(' env', c_custkey, ' ') WHEN 2 THEN '  ' END"),
            F.expr("CASE c_custkey % 7 WHEN 0 THEN ' none ' WHEN 1 THEN c_mktsegment END"),
            F.expr("CASE c_custkey % 3 WHEN 0 THEN '   ' WHEN 1 THEN 'none' ELSE concat(c_name, ' ') END"),
        ).alias("machine_id"),
    )


@query("f4_memory_gb", """SELECT o_orderkey, CAST((CAST(round(o_totalprice * 100) AS BIGINT) * 10007 + 536870912) // 1073741824 AS BIGINT) AS mem_gb FROM orders""")
def f4(spark, sf):
    size = F.round(F.col("o_totalprice") * 100).cast("bigint") * 10007
    return table(spark, sf, "orders").select("o_orderkey", config.memory_gb(size).alias("mem_gb"))


_ENV_NAMES = (
    "'RUSTFLAGS', 'HOME', 'CARGO_ENCODED_RUSTFLAGS', 'RUSTC_WRAPPER', 'PATH', 'RUSTC_WORKSPACE_WRAPPER', "
    "'CARGO_BUILD_TARGET', 'TOKEN', 'CARGO_BUILD_JOBS', 'CARGO_INCREMENTAL'"
)


@query("f5_environment", f"""WITH v AS (SELECT p_partkey AS k, p_brand, p_type, p_name, [{_ENV_NAMES}][1 + p_partkey % 10] AS name FROM part)
    SELECT 'r' || k AS run_id, name, CASE name
      WHEN 'RUSTFLAGS' THEN '["-C opt-level=' || p_brand || '","-Clinker=' || p_type || '"]'
      WHEN 'CARGO_ENCODED_RUSTFLAGS' THEN '["-C link-arg=<path>","--cfg ' || p_name || '"]'
      WHEN 'RUSTC_WRAPPER' THEN p_type WHEN 'RUSTC_WORKSPACE_WRAPPER' THEN NULL ELSE p_brand END AS value
    FROM v WHERE name NOT IN ('HOME', 'PATH', 'TOKEN', 'RUSTC_WORKSPACE_WRAPPER')""")
def f5(spark, sf):
    variables = table(spark, sf, "part").selectExpr(
        "concat('r', p_partkey) AS run_id",
        f"element_at(array({_ENV_NAMES}), CAST(1 + p_partkey % 10 AS INT)) AS name",
        "p_brand", "p_type", "p_name",
    ).selectExpr("run_id", "name", r"""CASE name
        WHEN 'RUSTFLAGS' THEN concat(' -C  opt-level=', p_brand, ' -L /usr/lib  -Clinker=/usr/bin/', p_type, ' --remap-path-prefix=/a=/b ')
        WHEN 'CARGO_ENCODED_RUSTFLAGS' THEN concat('-C', chr(31), 'link-arg=/x/y', chr(31), '--cfg', chr(31), p_name, chr(31))
        WHEN 'RUSTC_WRAPPER' THEN concat('C:\\bin\\', p_type, ' ') WHEN 'RUSTC_WORKSPACE_WRAPPER' THEN '  ' ELSE p_brand END AS value""")
    return config.environment(variables)


_FLAG_WORDS = """words AS (SELECT doc_id, CASE length(x) % 6 WHEN 0 THEN '-C' WHEN 1 THEN '--cfg' ELSE x END AS t, i
      FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM
        (SELECT doc_id, list_filter(string_split_regex(text, '[\\s\\x{00A0}\\x{0085}\\x{000B}]+'), lambda x: x <> '') AS w FROM documents)))"""


@query("f6_flag_rejoin", f"""WITH {_FLAG_WORDS},
    v AS (SELECT *, t IN ('-C', '--cfg') AS takes, i - row_number() OVER (PARTITION BY doc_id, t IN ('-C', '--cfg') ORDER BY i) AS run FROM words),
    o AS (SELECT *, takes AND row_number() OVER (PARTITION BY doc_id, takes, run ORDER BY i) % 2 = 1 AS opens FROM v),
    g AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS nxt, coalesce(lag(opens) OVER (PARTITION BY doc_id ORDER BY i), false) AS eaten FROM o)
    SELECT doc_id, string_agg(CASE WHEN opens AND nxt IS NOT NULL THEN t || ' ' || nxt ELSE t END, '|' ORDER BY i) AS flags
    FROM g WHERE NOT eaten GROUP BY doc_id""")
def f6(spark, sf):
    words = F.filter(F.split("text", r"\p{IsWhite_Space}+"), lambda x: x != "")
    raw = F.array_join(
        F.transform(words, lambda x: F.when(F.length(x) % 6 == 0, F.lit("-C")).when(F.length(x) % 6 == 1, F.lit("--cfg")).otherwise(x)), " "
    )
    return table(spark, sf, "documents").select("doc_id", F.array_join(flags.split_flags(raw), "|").alias("flags"))


@query("f7_sanitise_flags", """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_partkey % 9 AS k, 'v' || l_suppkey AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE k WHEN 0 THEN '-Copt-level=' || v WHEN 1 THEN '-C linker=' || v WHEN 2 THEN '-C link-arg=<path>'
      WHEN 3 THEN NULL WHEN 4 THEN '--' || v WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN 'a=b=' || v ELSE '-C\\x=' || v END AS flag FROM f""")
def f7(spark, sf):
    raw = F.expr(r"""CASE l_partkey % 9 WHEN 0 THEN concat(' -Copt-level=v', l_suppkey, ' ') WHEN 1 THEN concat('-C linker=/usr/bin/v', l_suppkey)
        WHEN 2 THEN concat('-C link-arg=C:\\lib\\v', l_suppkey) WHEN 3 THEN concat('--remap-path-prefix=v', l_suppkey, '=x')
        WHEN 4 THEN concat('--v', l_suppkey) WHEN 5 THEN concat('-L/usr/v', l_suppkey) WHEN 6 THEN '   '
        WHEN 7 THEN concat('a=b=v', l_suppkey) ELSE concat('-C\\x=v', l_suppkey) END""")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", flags.sanitise_flag(raw).alias("flag")
    )


@query("f8_program_name", """SELECT page_id, nullif(CASE WHEN page_id % 10 = 0 THEN NULL ELSE regexp_extract(url, '[^/\\\\]*$') END, chr(0)) AS program,
      CASE WHEN page_id % 3 = 0 THEN 'b' || page_id ELSE 'sccache' END AS other FROM pages""")
def f8(spark, sf):
    blank = F.when(F.col("page_id") % 10 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" "), "url", F.lit(" ")))
    other = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("C:\\a/x\\b"), "page_id")).otherwise(F.lit("/usr/local/bin/sccache"))
    return table(spark, sf, "pages").select(
        "page_id", flags.program_name(blank).alias("program"), flags.program_name(other).alias("other")
    )


_CONFIG_KEYS = (
    "'build.incremental', 'build.rustc-wrapper', 'target.x86.linker', 'build.rustflags', 'net.offline', "
    "'target.arm.rustflags', 'build.jobs', 'profile.dev.debug'"
)


@query("f9_config_layers", f"""WITH raw AS (SELECT 'o' || l_orderkey AS run_id, CASE WHEN l_returnflag = 'R' THEN 'workspace' ELSE 'home' END AS layer,
      [{_CONFIG_KEYS}][1 + l_partkey % 8] AS key, max(l_suppkey) AS s FROM lineitem GROUP BY ALL),
    safe AS (SELECT run_id, layer, key, CASE WHEN key IN ('build.incremental', 'build.jobs') THEN 's' || s
        WHEN key IN ('build.rustc-wrapper', 'target.x86.linker') THEN 'tool' || s
        WHEN key IN ('build.rustflags', 'target.arm.rustflags') THEN '["-C target-cpu=c' || s || '","-C link-arg=<path>"]' END AS value FROM raw)
    SELECT run_id, key, coalesce(max(value) FILTER (WHERE layer = 'workspace'), max(value)) AS value
    FROM safe WHERE value IS NOT NULL GROUP BY run_id, key""")
def f9(spark, sf):
    raw = (
        table(spark, sf, "lineitem")
        .groupBy(
            F.concat(F.lit("o"), "l_orderkey").alias("run_id"),
            F.when(F.col("l_returnflag") == "R", F.lit("workspace")).otherwise(F.lit("home")).alias("layer"),
            F.expr(f"element_at(array({_CONFIG_KEYS}), CAST(1 + l_partkey % 8 AS INT))").alias("key"),
        )
        .agg(F.max("l_suppkey").alias("s"))
        .selectExpr("run_id", "layer", "key", """CASE WHEN key IN ('build.incremental', 'build.jobs') THEN concat('"s', s, '"')
            WHEN key IN ('build.rustc-wrapper', 'target.x86.linker') THEN concat('"/opt/bin/tool', s, '"')
            ELSE concat('["-C", "target-cpu=c', s, '", "-C", "link-arg=/x/y", "-L/usr/lib"]') END AS value""")
    )
    return config.merged_config(raw)


_FILES = """files AS (SELECT 't' || (l_orderkey % 50) AS target_dir, replace(p_name, ' ', '_') AS crate, l_linenumber AS k, l_quantity::BIGINT AS length
      FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def artifact_files(spark, sf):
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(part, li.l_partkey == part.p_partkey).selectExpr(
        "concat('t', l_orderkey % 50) AS target_dir",
        """concat('/w/t', l_orderkey % 50, IF(l_linenumber = 6, '/bench', '/debug'), '/deps/', IF(l_linenumber = 3, '', 'lib'), replace(p_name, ' ', '_'),
             IF(l_linenumber = 7, '', concat('-', hex(l_partkey))), '.',
             CASE l_linenumber WHEN 1 THEN 'rmeta' WHEN 2 THEN 'rlib' WHEN 3 THEN 'o' WHEN 4 THEN 'd' ELSE 'rlib' END) AS path""",
        "CAST(l_quantity AS BIGINT) AS length",
    )


_BYTES = """bytes AS (SELECT target_dir, crate, coalesce(sum(length) FILTER (WHERE k = 1), 0)::BIGINT AS rmeta,
      coalesce(sum(length) FILTER (WHERE k IN (2, 5)), 0)::BIGINT AS rlib, coalesce(sum(length) FILTER (WHERE k = 3), 0)::BIGINT AS obj
      FROM files WHERE k NOT IN (6, 7) GROUP BY 1, 2)"""


@query("f10_crate_bytes", f"WITH {_FILES}, {_BYTES} SELECT * FROM bytes")
def f10(spark, sf):
    return config.crate_bytes(artifact_files(spark, sf))


@query("f11_public_bytes", f"""WITH {_FILES}, {_BYTES},
    listed AS (SELECT 't' || (o_orderkey % 50) AS target_dir, replace(p_name, ' ', '_') AS crate, count(*) AS n
      FROM orders JOIN part ON p_partkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2),
    totals AS (SELECT target_dir, sum(rmeta * n)::BIGINT AS rmeta, sum(rlib * n)::BIGINT AS rlib, sum(obj * n)::BIGINT AS obj
      FROM bytes JOIN listed USING (target_dir, crate) GROUP BY 1),
    uniq AS (SELECT target_dir, sum(rmeta)::BIGINT AS rmeta, sum(rlib)::BIGINT AS rlib, sum(obj)::BIGINT AS obj
      FROM bytes JOIN listed USING (target_dir, crate) GROUP BY 1)
    SELECT 'listed' AS rule, * FROM totals UNION ALL SELECT 'distinct', * FROM uniq""")
def f11(spark, sf):
    per = materialise(config.crate_bytes(artifact_files(spark, sf)), "crate-bytes")
    o, part = table(spark, sf, "orders").where("o_orderstatus = 'F'"), table(spark, sf, "part")
    crates = o.join(part, o.o_custkey == part.p_partkey).selectExpr(
        "concat('t', o_orderkey % 50) AS target_dir", "replace(p_name, ' ', '-') AS crate"
    )
    out = None
    for rule, distinct in (("listed", False), ("distinct", True)):
        total = config.byte_totals(config.public_bytes(per, crates, distinct)).select(F.lit(rule).alias("rule"), "*")
        out = total if out is None else out.unionByName(total)
    return out


# ------------------------------------------------------------------ G: build reports


@query("g1_report_match", """WITH b AS (SELECT o_orderkey, 't' || o_custkey AS target_dir, o_orderdate + to_minutes(CAST(o_orderkey % 3 AS INTEGER)) AS started, o_orderkey % 11 = 0 AS odd FROM orders),
    r AS (SELECT 't' || o_custkey AS target_dir, CASE o_orderkey % 5 WHEN 0 THEN 'cargo-timing.html' WHEN 1 THEN 'x' ELSE 'cargo-timing-' || strftime(o_orderdate, '%Y%m%d') || 'T000' || (o_orderkey % 2) || '59Z-' || o_orderkey || '.html' END AS name,
      epoch_us(o_orderdate) + o_orderkey AS modified FROM orders),
    newest AS (SELECT target_dir, arg_max(name, modified) AS name FROM r WHERE starts_with(name, 'cargo-timing-') GROUP BY 1)
    SELECT 'o' || o_orderkey AS run_id, CASE WHEN NOT odd AND substr(name, 14, 13) = strftime(started, '%Y%m%dT%H%M') THEN name END AS report
    FROM b LEFT JOIN newest USING (target_dir)""")
def g1(spark, sf):
    o = table(spark, sf, "orders")
    builds = o.selectExpr(
        "concat('o', o_orderkey) AS run_id",
        "concat('t', o_custkey) AS target_dir",
        """IF(o_orderkey % 11 = 0, date_format(o_orderdate, 'yyyy-MM-dd'),
             concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:0', o_orderkey % 3, ':41.070253Z')) AS started""",
    )
    made = o.selectExpr(
        "concat('t', o_custkey) AS target_dir",
        """CASE o_orderkey % 5 WHEN 0 THEN 'cargo-timing.html' WHEN 1 THEN 'x' ELSE
             concat('cargo-timing-', date_format(o_orderdate, 'yyyyMMdd'), 'T000', o_orderkey % 2, '59Z-', o_orderkey, '.html') END AS name""",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate) + o_orderkey AS modified",
    )
    return reports.match_reports(builds, made)


def report_pages(spark, sf):
    """Pages, two thirds of them with build data appended to their script."""
    data = F.expr(r"""concat(html, CASE page_id % 3 WHEN 0 THEN concat('<script>const UNIT_DATA = [{"i":', page_id, ',"name":"a]b\\"[","deps":[1,[2]]},{"i":1}];',
        char(10), 'const CONCURRENCY_DATA = [{"t":0.5,"active":', page_id % 7, ',"waiting":0,"inactive":2}];</script>')
        WHEN 1 THEN concat('<script>const CPU_USAGE = [[0.25,', page_id % 101, '],[0.5,3]];const UNIT_DATA = [1,2;</script>') ELSE '' END)""")
    return table(spark, sf, "pages").select("page_id", data.alias("html"))


_BLOCKS_SQL = """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(2 AS BIGINT) END AS units, CASE WHEN page_id % 3 = 0 THEN 'a]b"[' END AS name,
      CASE WHEN page_id % 3 = 0 THEN CAST(page_id % 7 AS BIGINT) END AS active, CASE WHEN page_id % 3 = 1 THEN CAST(page_id % 101 AS DOUBLE) END AS cpu FROM pages"""


def read_blocks(pages):
    return pages.select(
        "page_id",
        F.size(coerce.items(F.col("unit_data"))).cast("bigint").alias("units"),
        coerce.text(F.col("unit_data"), "$[0].name").alias("name"),
        coerce.integer(F.col("concurrency_data"), "$[0].active").alias("active"),
        coerce.number(F.col("cpu_usage"), "$[0][1]").alias("cpu"),
    )


@query("a8_report_scan", _BLOCKS_SQL)
def a8(spark, sf):
    return read_blocks(reports.report_blocks(report_pages(spark, sf)))


@query("g2_embedded_blocks", """SELECT page_id, page_id % 3 = 0 AS unit_data, page_id % 3 = 0 AS concurrency_data, page_id % 3 = 1 AS cpu_usage FROM pages""")
def g2(spark, sf):
    found = reports.report_blocks(report_pages(spark, sf))
    return found.select("page_id", *[F.col(b.lower()).isNotNull().alias(b.lower()) for b in reports.BLOCKS])


@query("g3_timings_document", _BLOCKS_SQL.replace("FROM pages", "FROM pages WHERE page_id % 3 <> 2"))
def g3(spark, sf):
    docs = reports.timings_document(reports.report_blocks(report_pages(spark, sf))).where("timings IS NOT NULL")
    v = F.parse_json("timings")
    names = [b.lower() for b in reports.BLOCKS]
    return read_blocks(docs.select("page_id", *[F.try_variant_get(v, f"$.{n}", "variant").alias(n) for n in names]))
