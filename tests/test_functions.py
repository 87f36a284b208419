"""Column expressions on small cases."""

import pytest
from pyspark.sql import functions as F

from forgeclock.functions import coerce, flags, ids, symbols
from forgeclock.operators import config, reports


def apply(spark, fn, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[0] for r in df.select(fn(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def facts(spark, line):
    df = spark.createDataFrame([(line,)], "x string")
    return df.select(F.inline(flags.compile_facts(F.col("x")))).first()


SOURCES = "/work/.cargo/registry/src/mirror-7f"


def test_quoted_arguments(spark):
    u = facts(spark, "rustc '--edition=2018' --crate-name tide_pool --crate-type rlib '--emit=metadata' lib/tide/pool.rs")
    assert (u.is_compile, u.crate, u.crate_type, u.package) == (True, "tide_pool", "rlib", "tide_pool")
    assert u.settings == {"edition": "2018"}


def test_compiler_probe_is_no_unit(spark):
    for line in (
        "rustc --print sysroot --crate-name probe -",
        "rustc --crate-name gull --print=target-list gull.rs",
        "clang --crate-name gull gull.rs",
        "rustc --version",
    ):
        assert not facts(spark, line).is_compile, line


def test_build_scripts_of_two_packages(spark):
    lines = {
        ("heron-sys-4.2.0", "h17"): f"rustc --crate-name build_script_build --crate-type bin {SOURCES}/heron-sys-4.2.0/build.rs -C 'metadata=h17'",
        ("osprey-0.9.13", "h18"): f"rustc --crate-name build_script_build --crate-type bin {SOURCES}/osprey-0.9.13/build.rs -C 'metadata=h18'",
    }
    for (package, unit), line in lines.items():
        u = facts(spark, line)
        assert (u.package, u.unit_hash) == (package, unit)
    assert facts(spark, f"rustc --crate-name plover {SOURCES}/plover-2.0.0/src/lib.rs").package == "plover-2.0.0"


def test_settings_keep_shape_and_drop_machine(spark):
    parts = [
        f"rustc {SOURCES}/plover-2.0.0/src/lib.rs --crate-name plover --crate-type lib",
        "-Copt-level=0 -C 'opt-level=s' -C 'panic=unwind' -C 'codegen-units=5' -C 'debuginfo=1'",
        "'--edition=2018' --target riscv64gc-unknown-linux-gnu",
        "-C 'incremental=/work/inc' -C 'extra-filename=-q1' -C 'metadata=q1' -L 'dependency=/work/deps' --out-dir /work/out",
        "--cfg 'feature=\"wings\"' --cfg 'feature=\"beak\"' --cfg 'feature=\"wings\"'",
    ]
    assert facts(spark, " ".join(parts)).settings == {
        "codegen-units": "5", "debuginfo": "1", "edition": "2018", "features": "beak,wings", "incremental": "true", "opt-level": "s",
        "panic": "unwind", "target": "riscv64gc-unknown-linux-gnu",
    }


def test_long_command_line(spark):
    line = "rustc --crate-name big " + " ".join(f"'--cfg=f{i} x'" for i in range(20_000)) + " " + "y" * 200_000
    assert facts(spark, line).crate == "big"


def test_open_quote_runs_to_the_end(spark):
    assert apply(spark, flags.tokens, ["a 'b c", "", "  ", "''"]) == [["a", "b c"], [], [], []]


def test_parked_leaves(spark):
    waits = ["epoll_wait", "pthread_cond_wait", "__ulock_wait2", "semaphore_wait"]
    busy = ["rustc_ast::visit", "llvm::SCCPPass", "memcpy"]
    got = apply(spark, symbols.is_wait, [*waits, *busy, None])
    assert got[len(waits) :] == [False] * len(busy) + [None]
    assert all(isinstance(g, bool) for g in got[: len(waits)])


def test_symbol_to_phase(spark):
    known = {
        "rustc_expand::base::cx": "macro_expand",
        "<rustc_borrowck::dataflow as x>::go": "borrowck",
        "rustc_hir_analysis::collect::item": "type_check",
        "rustc_hir_analysis::coherence::builtin": "coherence",
        "alloc::string::String::push": None,
    }
    assert apply(spark, symbols.phase_marker, list(known)) == list(known.values())


def test_thread_class(spark):
    known = {"opt cgu.07": "parallel", "codegen cgu.31": "parallel", "coordinator": "parallel", "main": "serial", None: "serial"}
    assert apply(spark, symbols.thread_class, list(known)) == list(known.values())


def test_sanitise_flags(spark):
    raw = [
        "-C opt-level=2", "-Ctarget-cpu=native", "-Zthreads=8", "-C linker=/usr/bin/clang", "-C link-arg=-fuse-ld=mold",
        "-C link-arg=/work/x", "-L/usr/lib", "--remap-path-prefix=/a=/b", "", "-O", "-C linker=C:\\llvm\\lld",
    ]
    assert apply(spark, flags.sanitise_flag, raw) == [
        "-C opt-level=2", "-Ctarget-cpu=native", "-Zthreads=8", "-C linker=clang", "-C link-arg=-fuse-ld=mold",
        "-C link-arg=<path>", None, None, None, "-O", "-C linker=lld",
    ]


def test_rejoin_spaced_flags(spark):
    raw = ["-C opt-level=2 -Zthreads=8 --cfg foo", "-C -C x -C", " ", "-C -C -C -C"]
    assert apply(spark, flags.split_flags, raw) == [
        ["-C opt-level=2", "-Zthreads=8", "--cfg foo"], ["-C -C", "x", "-C"], [], ["-C -C", "-C -C"],
    ]
    assert apply(spark, lambda c: flags.split_flags(c, True), ["-C\x1flink-arg=a b\x1f-O"]) == [["-C link-arg=a b", "-O"]]


def test_program_name(spark):
    assert apply(spark, flags.program_name, ["/opt/tools/wrapper", "", "  ", "mold", "C:\\x\\y.exe", "/a/"]) == [
        "wrapper", None, None, "mold", "y.exe", "",
    ]


def test_linker(spark):
    df = spark.createDataFrame([(["-C linker=clang", "-C link-arg=-fuse-ld=mold"],), (["-O"],)], "f array<string>")
    assert [r[0] for r in df.select(flags.linker_of(F.col("f"))).collect()] == ["mold", "default"]


def test_package_name(spark):
    raw = ["x+https://h/i#serde@1.0.0", "x#1.0.0", "no-hash", "x#", "a#b#c@1", "x#@1", None]
    assert apply(spark, ids.package_name, raw) == ["serde", "1.0.0", None, None, "c", None, None]


def test_public_predicate(spark):
    raw = [
        "registry+https://github.com/rust-lang/crates.io-index#a@1", "sparse+https://index.crates.io/#a@1",
        "git+https://h/r#1.0", "git+https://h/r#n@1.0", "path+file:///h/foo#1.0", "registry+https://other/#a@1", None,
    ]
    assert apply(spark, ids.is_public, raw) == [True, True, True, False, False, False, False]
    assert apply(spark, lambda c: ids.is_public(c, strict_git=False), raw)[3] is True
    assert apply(spark, lambda c: ids.is_public(c, F.lit(True)), raw)[4] is True


def test_canonical_ids(spark):
    raw = ["path+file:///h/foo#1.0", "path+file:///h/dir#bar@2.0", "path+file:///h/foo", "path+file:///h/foo//#3", "path+x#a#b", "git+x#1"]
    assert apply(spark, ids.canonical_id, raw) == [
        "workspace#foo@1.0", "workspace#bar@2.0", "workspace", "workspace#foo@3", "workspace#x@a#b", "git+x#1",
    ]


def test_scrub_command(spark):
    words = [["/x/cargo", "build", "-Zq", "--p=/y", None]]
    assert apply(spark, ids.scrub_command, words, "array<string>") == [["cargo", "<arg>", "-Zq", "--p=/y"]]
    assert apply(spark, lambda c: ids.scrub_command(c, True), words, "array<string>") == [["cargo", "<arg>", "-Zq", "--p=<path>"]]


def test_version_order(spark):
    assert apply(spark, ids.version_key, ["1.10.0", "1.9.0-beta.2"]) == [[1, 10, 0], [1, 9, 0, 2]]


@pytest.mark.parametrize(
    "text, number, integer, truth",
    [
        ('"0.75"', 0.75, 0, True), ('"1"', 1.0, 1, True), ("2.9", 2.9, 2, True), ("-2.9", -2.9, -2, True),
        ('"false"', None, None, True), ("false", 0.0, 0, False), ("true", 1.0, 1, True), ("0", 0.0, 0, False),
        ('""', 0.0, 0, False), ('"Infinity"', None, None, True), ('"NaN"', None, None, True), ("null", None, None, None),
        ("{}", None, None, True), ("[]", None, None, True),
    ],
)
def test_coercion(spark, text, number, integer, truth):
    v = F.col("v")
    df = spark.createDataFrame([(f'{{"x":{text}}}',)], "t string").select(F.parse_json("t").alias("v"))
    assert tuple(df.select(coerce.number(v, "$.x"), coerce.integer(v, "$.x"), coerce.truth(v, "$.x")).first()) == (number, integer, truth)


def test_machine_id(spark):
    rows = [("none", "acme", "f"), (None, " acme ", "f"), (None, None, "  "), (None, None, " f\t"), ("", "acme", "f"), (None, None, "none")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = [r[0] for r in df.select(config.machine_id(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [None, "acme", None, "f", None, None]


def test_memory_rounds_to_nearest(spark):
    gib = 1 << 30
    assert apply(spark, config.memory_gb, [16 * gib, 16 * gib + gib // 2, 16 * gib + gib // 2 - 1], "bigint") == [16, 17, 16]


def test_report_stamp(spark):
    got = apply(spark, reports.stamp_prefix, ["2031-02-03T04:05:59Z", "yesterday", "2031-02-03T4", None])
    assert got == ["cargo-timing-20310203T0405", None, None, None]


def test_report_blocks(spark):
    html = (
        '<script>const UNIT_DATA = [{"i":0,"features":["a]b","c\\"["]},{"i":1}];\n'
        'const CONCURRENCY_DATA = [{"t":0.1,"active":1,"waiting":0,"inactive":2}];</script>'
    )
    df = spark.createDataFrame([(html,), ("const OTHER = [1];",), ("const UNIT_DATA = [1,2",), ("const UNIT_DATA = nope",)], "html string")
    rows = reports.report_blocks(df).select(
        F.to_json("unit_data").alias("u"), coerce.integer(F.col("concurrency_data"), "$[0].waiting").alias("w"), F.col("cpu_usage").isNull().alias("c")
    ).collect()
    assert rows[0].u == '[{"features":["a]b","c\\"["],"i":0},{"i":1}]' and rows[0].w == 0 and rows[0].c
    assert [r.u for r in rows[1:]] == [None, None, None]
    docs = [r.timings for r in reports.timings_document(reports.report_blocks(df)).collect()]
    assert docs[0].startswith('{"unit_data":[') and '"concurrency_data":[' in docs[0] and docs[1] is None


def test_precedence(spark):
    """The order of the published rules, numbers beyond 64 bits included."""
    from pyspark.sql import functions as F

    ordered = ["0.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1-0", "1.2.0", "1.10.0",
               "1.99999999999999999999.0", "1.100000000000000000000.0", "2.0.0"]
    rows = spark.createDataFrame([(v,) for v in reversed(ordered)], "v string")
    assert [r.v for r in rows.orderBy(ids.precedence_key(F.col("v"))).collect()] == ordered
    same = spark.createDataFrame([("1.0.0+a", "1.0.0+b.2"), ("1.0.0-rc.1+x", "1.0.0-rc.1"), ("1.007", "1.7")], "a string, b string")
    assert all(r.same for r in same.select((ids.precedence_key(F.col("a")) == ids.precedence_key(F.col("b"))).alias("same")).collect())
