"""Saved profiles to phase counts, against a plain stack walk."""

import json
import random

from pyspark.sql import functions as F

from forgeclock.operators import profile

SYMBOLS = [
    "main", "rustc_expand::x", "rustc_hir_analysis::coherence::y", "rustc_hir_typeck::z", "rustc_borrowck::b",
    "rustc_codegen_llvm::c", "std::vec", "futex_wait", "rustc_trait_selection::t",
]
MARK = dict(zip(SYMBOLS, [None, "macro_expand", "coherence", "type_check", "borrowck", "codegen", None, None, None]))


def variant(spark, rows, names):
    return spark.createDataFrame(rows, f"{names[0]} string, t string").select(names[0], F.parse_json("t").alias("v"))


def make(seed):
    """A profile document, its sidecar, and the counts a stack walk gives."""
    rng = random.Random(seed)
    rvas = sorted(rng.sample(range(10, 1000), len(SYMBOLS)))
    sidecar = {"string_table": SYMBOLS, "data": [{"code_id": "L1", "debug_id": "ab-cd", "symbol_table": [{"rva": r, "symbol": i} for i, r in enumerate(rvas)]}]}

    def resolve(addr):
        hit = [s for r, s in zip(rvas, SYMBOLS) if r <= addr]
        return hit[-1] if hit else None

    threads, want = [], {}
    for t in range(4):
        n = 120
        addr = [rng.choice([rng.randint(0, 1100), rng.randint(0, 12)]) for _ in range(n)]
        prefix = [None] + [max(0, i - rng.choice([1, 1, 1, 2, 5])) for i in range(1, n)]
        stack = [rng.choice([None, *range(n)]) for _ in range(300)]
        name = ["rustc", "opt cgu.0", "coordinator", "main"][t]
        threads.append({
            "processName": "rustc --crate-name a src/lib.rs -C metadata=m1", "name": name,
            "processStartupTime": 1000.0, "processShutdownTime": 2500.0 if t else 900.0,
            "frameTable": {"address": addr, "func": [0] * n}, "funcTable": {"resource": [0]}, "resourceTable": {"lib": [0]},
            "stackTable": {"frame": list(range(n)), "prefix": prefix}, "samples": {"stack": stack},
        })
        for s in stack:
            if s is None:
                continue
            chain = []
            while s is not None:
                sym = resolve(addr[s])
                if sym:
                    chain.append(sym)
                s = prefix[s]
            if chain and chain[0].endswith("futex_wait"):
                phase = "blocked"
            else:
                phase = next((MARK[c] for c in reversed(chain) if MARK[c]), "unattributed")
            side = "parallel" if t in (1, 2) else "serial"
            want[side, phase] = want.get((side, phase), 0) + 1
    return {"libs": [{"codeId": "L1"}], "threads": threads}, sidecar, want


def test_attribution_matches_a_stack_walk(spark):
    doc, sidecar, want = make(7)
    p = variant(spark, [("p", json.dumps(doc))], ["profile_id"])
    s = variant(spark, [("s", json.dumps(sidecar))], ["k"])
    facts = profile.path_facts(profile.named_nodes(profile.node_table(p), profile.symbol_table(s)))
    units = profile.unit_threads(profile.thread_table(p))
    counts = profile.phase_counts(profile.attributed(profile.sample_table(p), facts, units))
    assert {(r.thread, r.phase): r.samples for r in counts.collect()} == want
    assert profile.unit_walls(units).first().wall_s == 1.5
    doc = json.loads(profile.phases_documents(counts, profile.unit_walls(units), 4999, "s").first().unit)
    assert doc["serial"] == {p: n for (t, p), n in want.items() if t == "serial"}
    assert (doc["crate"], doc["wall_s"], doc["flags"]) == ("a", 1.5, {})


def test_symbol_lookup(spark):
    table = spark.createDataFrame([("l", 10, "first"), ("l", 20, "second")], "lib string, rva bigint, symbol string")
    probes = spark.createDataFrame([("l", a) for a in (5, 10, 19, 20, 1 << 40)] + [("x", 10)], "lib string, addr bigint")
    got = {(r.lib, r.addr): r.symbol for r in profile.resolve_symbols(probes, table).collect()}
    assert got == {("l", 5): None, ("l", 10): "first", ("l", 19): "first", ("l", 20): "second", ("l", 1 << 40): "second", ("x", 10): None}


def test_library_ids(spark):
    _, sidecar, _ = make(1)
    s = variant(spark, [("s", json.dumps(sidecar))], ["k"])
    assert {r.lib for r in profile.symbol_table(s).select("lib").distinct().collect()} == {"L1", "ABCD"}


def test_deep_chain_takes_few_rounds(spark):
    n = 1000
    rows = [("p", 0, i, i - 1 if i else None, "rustc_borrowck::x" if i == 0 else None) for i in range(n)]
    nodes = spark.createDataFrame(rows, "profile_id string, thread_pos int, node int, prefix int, symbol string")
    facts = profile.path_facts(nodes)
    assert facts.where("phase = 'borrowck'").count() == n


def test_outermost_marker_wins(spark):
    rows = [("p", 0, 0, None, "rustc_hir_typeck::a"), ("p", 0, 1, 0, "rustc_hir_analysis::coherence"), ("p", 0, 2, 1, "rustc_borrowck::b"), ("p", 0, 3, 2, None), ("p", 0, 4, 3, "futex_wait")]
    nodes = spark.createDataFrame(rows, "profile_id string, thread_pos int, node int, prefix int, symbol string")
    got = {r.node: r.p for r in profile.path_facts(nodes).select("node", profile.sample_phase().alias("p")).collect()}
    assert got == {0: "type_check", 1: "type_check", 2: "type_check", 3: "type_check", 4: "blocked"}


def test_build_script_runs(spark):
    rows = [("p", 0, "/t/debug/build/x/build-script-build --v", "main", 1000.0, 1250.0), ("p", 1, "rustc --crate-name build_script_build b.rs", "m", 0.0, 9.0)]
    threads = spark.createDataFrame(rows, "profile_id string, thread_pos int, process_name string, name string, startup_ms double, shutdown_ms double")
    assert [r.wall_s for r in profile.build_script_runs(threads).collect()] == [0.25]
