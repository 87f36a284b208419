"""Study models on small hand-made tables."""

import math

import pytest
from pyspark.sql import functions as F

from forgeclock.operators import config, study
from forgeclock.operators.connected import connected
from forgeclock.operators.effects import crossed_effects


def test_crossed_effects_recover_a_planted_model(spark):
    a = {"x": 3.0, "y": 5.0, "z": 4.0}
    b = {"m0": 0.0, "m1": 0.7, "m2": -0.4}
    rows = [(c, m, a[c] + b[m] + 0.1 * ld, float(ld)) for c in a for m in b for ld in (0, 1, 4) if (c, m) != ("z", "m2")]
    unknown = [(c, m, y + 3, None) for c, m, y, _ in rows] + [("x", "m0", None, 2.0)]
    obs = spark.createDataFrame(rows + unknown, "class_id string, machine_id string, y double, load double")
    fit = crossed_effects(obs, "m0")
    assert fit.slope == pytest.approx(0.1, abs=1e-6) and fit.left_out == len(unknown) and 1 < fit.rounds < 9
    for r in fit.classes.collect():
        assert r.intrinsic == pytest.approx(a[r.class_id], abs=1e-6)
    for r in fit.machines.collect():
        assert r.speed == pytest.approx(b[r.machine_id], abs=1e-6)
    with pytest.raises(RuntimeError, match="no fit"):
        crossed_effects(obs, "m0", max_rounds=1)


def test_a_zero_fails_no_job(spark):
    phases = spark.createDataFrame([("r", "c", "p", "lib", "blocked", 0)], "run_id string, crate string, package string, crate_type string, phase string, samples bigint")
    assert study.blocked_share(phases).first().blocked_share is None
    sessions = spark.createDataFrame([(True, 4, 0, 1.0), (True, 4, 8, 2.0), (None, 4, 8, 2.0)], "ci boolean, jobs bigint, cpu_cores bigint, loadavg_mean double")
    rows = {r.ci: r for r in study.jobs_per_core(sessions).collect()}
    assert rows[True].median == 500.0 and rows[True].load_per_core == 0.25 and None in rows
    assert sessions.select(study.contention_weight(F.col("loadavg_mean"), F.col("cpu_cores")).alias("w")).first().w is None
    readings = spark.createDataFrame([("m", "2026-01-01", 0), ("n", "2025-01-01", 8)], "machine_id string, observed_at string, cost_us bigint")
    got = {r.machine_id: (r.speed, r.weight) for r in study.candle_calibration(readings, "2025-06-01").collect()}
    assert got == {"m": (None, 1.0), "n": (0.5, 0.5)}
    sides = study.ci_and_local(sessions.withColumn("k", F.lit(1)), ["k"]).first()
    assert (sides.ci, sides.local, sides.unknown) == (2, 0, 1)


def test_key_reconciliation(spark):
    units = spark.createDataFrame(
        [("r", "serde-x", "registry#serde@1.0.229", 2.0, 1.0, 1.0, None), ("r", "my-app", "workspace#my-app@0.1", 1.0, None, None, None)],
        "run_id string, crate string, package_id string, duration double, frontend double, codegen double, link double",
    )
    phases = spark.createDataFrame(
        [("r", "serde_x", "serde-1.0.229", "serial", "borrowck", 8192, 2.5, 4096), ("r", "serde_x", "serde-1.0.229", "parallel", "codegen", 4096, 2.5, 4096),
         ("r", "my_app", "my_app", "serial", "blocked", 1, None, 4096)],
        "run_id string, crate string, package string, thread string, phase string, samples bigint, wall_s double, rate_hz bigint",
    )
    got = {r.crate: r for r in study.reconciled(units, phases).collect()}
    assert set(got) == {"serde_x", "my_app"} and (got["serde_x"].serial, got["serde_x"].parallel) == (8192, 4096)
    verdict = {r.crate: r.conserved for r in study.conservation(units, phases, 0.1).collect()}
    assert verdict == {"serde_x": True, "my_app": False}
    assert [r.parallelism for r in study.codegen_parallelism(units, phases).collect()] == [1.0]


def test_load_summary_and_stalls(spark):
    rows = [("a", 1, 0.0, 50.0, 100, None, 5), ("a", 2, 0.0, 70.0, 2_000_100, 7, 3), ("b", 1, 1.5, 10.0, None, None, None)]
    df = spark.createDataFrame(rows, "run_id string, ts int, loadavg double, cpu_pct double, psi_cpu bigint, psi_io bigint, psi_memory bigint")
    load = {r.run_id: r for r in config.load_summary(df).collect()}
    assert (load["a"].loadavg_mean, load["a"].cpu_busy_mean, load["a"].cpu_busy_max) == (None, 60.0, 70.0)
    assert load["b"].loadavg_max == 1.5
    stall = {r.run_id: r for r in config.stall_seconds(df).collect()}
    assert (stall["a"].cpu, stall["a"].io, stall["a"].memory) == (2.0, None, 0.0)


def test_artifact_bytes(spark):
    files = [("libfoo_bar-9a.rlib", 5), ("libfoo_bar-9b.rlib", 7), ("x.d", 1), ("foo-bar-1.rmeta", 2), ("liblib-1.o", 4), ("foo_bar-3.d", 9), ("odd-1.txt", 8)]
    df = spark.createDataFrame([("t", f"/w/target/debug/deps/{n}", s) for n, s in files], "target_dir string, path string, length bigint")
    got = {r.crate: (r.rmeta, r.rlib, r.obj) for r in config.crate_bytes(df).collect()}
    assert got == {"foo_bar": (0, 12, 0), "foo-bar": (2, 0, 0), "lib": (0, 0, 4), "odd": (0, 0, 0)}
    crates = spark.createDataFrame([("t", "foo-bar"), ("t", "foo-bar"), ("t", "none")], "target_dir string, crate string")
    per = config.crate_bytes(df)
    assert config.byte_totals(config.public_bytes(per, crates)).first().rlib == 24
    assert config.byte_totals(config.public_bytes(per, crates, distinct=True)).first().rlib == 12


def test_artifact_names(spark):
    names = {
        "foo-1.2.rmeta": "foo", "a-b-1.o": "a-b", "foo.bar-1": None, ".x-1": ".x", "foo-1": "foo", "libfoo": None,
        "lib-1.o": "", "foo-1.x-y": "foo", "nodash.rlib": None, "foo-.rlib": "foo",
    }
    df = spark.createDataFrame([(n, f"/w/release/deps/{n}", 1) for n in names], "target_dir string, path string, length bigint")
    got = {r.target_dir: r.crate for r in config.crate_bytes(df).collect()}
    assert got == {n: c for n, c in names.items() if c is not None}
    outside = spark.createDataFrame([("t", "/w/release/deps/sub/foo-1.o", 1), ("t", "/w/bench/deps/foo-1.o", 1)], "target_dir string, path string, length bigint")
    assert config.crate_bytes(outside).isEmpty()


def test_config_layers(spark):
    rows = [
        ("r", "home", "build.jobs", "4"), ("r", "workspace", "build.jobs", "8"), ("r", "home", "build.rustc-wrapper", '"/opt/sccache"'),
        ("r", "workspace", "net.offline", "true"), ("r", "home", "target.x.rustflags", '["-C", "linker=/usr/bin/ld", "-L/usr"]'),
    ]
    df = spark.createDataFrame(rows, "run_id string, layer string, key string, value string")
    assert {r.key: r.value for r in config.merged_config(df).collect()} == {
        "build.jobs": "8", "build.rustc-wrapper": "sccache", "target.x.rustflags": '["-C linker=ld"]',
    }


def test_contention_weight_of_unknown_load_is_unknown(spark):
    df = spark.createDataFrame([(8.0, 8), (None, 8)], "l double, c int")
    assert [r[0] for r in df.select(study.contention_weight(F.col("l"), F.col("c"))).collect()] == [0.5, None]


def test_versions_step_in_version_order(spark):
    rows = [("m", "p", v, c) for v, c in (("1.9", 100), ("1.10", 200), ("1.2", 50))]
    obs = spark.createDataFrame(rows, "machine_id string, package string, version string, cost_us bigint")
    got = {r.version: (r.previous, r.ratio) for r in study.version_steps(obs).collect()}
    assert got == {"1.2": (None, None), "1.9": ("1.2", 2.0), "1.10": ("1.9", 2.0)}


def test_post_stratification_restores_the_mix(spark):
    s = spark.createDataFrame([(True,)] * 6 + [(None,)] * 2, "ci boolean")
    target = spark.createDataFrame([(True, 0.5), (None, 0.5)], "ci boolean, share double")
    rows = study.post_stratify(s, target, ["ci"]).collect()
    assert math.isclose(sum(r.n * r.weight for r in rows), 8) and {r.ci: r.n * r.weight for r in rows} == {True: 4.0, None: 4.0}


def test_groups_without_common_builds_are_told_apart(spark):
    a = {"x": 3.0, "y": 5.0, "u": 2.0, "v": 9.0, "w": 1.0}
    b = {"m1": 0.0, "m2": 0.7, "m3": 0.0, "m4": 1.0, "m9": 0.0}
    groups = [("xy", ("m1", "m2")), ("uv", ("m3", "m4")), ("w", ("m9",))]
    rows = [(c, m, a[c] + b[m] + 0.2 * ld, float(ld)) for cs, ms in groups for c in cs for m in ms for ld in (0, 3)]
    obs = spark.createDataFrame(rows, "class_id string, machine_id string, y double, load double")
    fit = crossed_effects(obs, "m2")
    assert fit.slope == pytest.approx(0.2)
    got = {r.class_id: (r.intrinsic, r.anchor) for r in fit.classes.collect()}
    speed = {r.machine_id: (r.speed, r.component) for r in fit.machines.collect()}
    shift = {"x": 0.7, "y": 0.7, "u": 0.0, "v": 0.0, "w": 0.0}  # the asked machine is held at 0 where it is, the first one elsewhere
    assert {c: x for c, (x, _) in got.items()} == pytest.approx({c: a[c] + shift[c] for c in a})
    assert [got[c][1] for c in "xyuvw"] == ["m2", "m2", "m3", "m3", "m9"]
    assert {m: s for m, (s, _) in speed.items()} == pytest.approx({"m1": -0.7, "m2": 0.0, "m3": 0.0, "m4": 1.0, "m9": 0.0})
    assert len({c for _, c in speed.values()}) == 3
    empty = crossed_effects(obs.limit(0), "m2")
    assert (empty.slope, empty.left_out, empty.classes.count()) == (0.0, 0, 0)


def test_connected(spark):
    import random

    rng = random.Random(2)
    links = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)] + [(5000, 5000)]
    root = {n: n for link in links for n in link}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for x, y in links:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
