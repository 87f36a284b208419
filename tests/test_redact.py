"""Redaction: nothing about a private unit survives."""

from pyspark.sql import functions as F

from forgeclock.operators import redact

PUBLIC = "registry+https://github.com/rust-lang/crates.io-index#a@1"
SCHEMA = (
    "object_key string, pos bigint, reason string, index bigint, package_id string, target_name string, "
    "dependencies array<bigint>, unblocked array<bigint>"
)


def log(spark):
    rows = [
        ("k", 0, "build-started", None, None, None, None, None),
        ("k", 1, "unit-registered", 0, PUBLIC, "a", [0, 1, 0], None),
        ("k", 2, "unit-registered", 1, "path+file:///home/me/secret#0.1", "secret", [0], None),
        ("k", 3, "unit-started", 1, None, None, None, None),
        ("k", 4, "unit-finished", 0, None, None, None, [1, 0, 1]),
        ("other", 0, "unit-registered", 1, PUBLIC, "b", [1], None),
        ("other", 1, "unit-registered", None, "path+x#1", "odd", None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_private_events_and_edges_go(spark):
    out = {(r.object_key, r.pos): r for r in redact.redact(log(spark)).collect()}
    assert set(out) == {("k", 0), ("k", 1), ("k", 4), ("other", 0), ("other", 1)}
    assert out["k", 1].dependencies == [0, 0] and out["k", 4].unblocked == [0]
    assert out["other", 0].dependencies == [1]
    assert out["other", 1].package_id == "workspace#x@1"


def test_no_index_of_a_private_unit_is_left(spark):
    events = log(spark)
    private = redact.private_units(events)
    out = redact.redact(events)
    edges = out.select("object_key", F.explode(F.concat(F.coalesce("dependencies", F.array()), F.coalesce("unblocked", F.array()))).alias("index"))
    seen = out.select("object_key", "index").union(edges)
    assert seen.join(private, ["object_key", "index"]).isEmpty()


def test_withheld_counts(spark):
    assert {r.object_key: r.units_withheld for r in redact.withheld_counts(log(spark)).collect()} == {"k": 1, "other": 0}


def test_public_project_keeps_its_units(spark):
    out = redact.redact(log(spark), project_public=F.lit(True))
    ids = {r.package_id for r in out.collect() if r.package_id}
    assert out.count() == 7 and "workspace#secret@0.1" in ids and not any("home" in i for i in ids)


def test_public_crates_keep_order_and_repeats(spark):
    again = log(spark).union(spark.createDataFrame([("k", 9, "unit-registered", 5, PUBLIC, "a", None, None)], SCHEMA))
    rows = redact.public_crates(redact.redact(again)).where("object_key = 'k'").orderBy("pos").collect()
    assert [r.crate for r in rows] == ["a", "a"]


def test_ledger(spark):
    s = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "run_id string")
    ledger = spark.createDataFrame([("a",), ("c",)], "run_id string")
    assert [r.run_id for r in redact.unsent(s, ledger).collect()] == ["b"]
    named = redact.unsent(s, ledger, F.col("run_id") == "c")
    assert sorted(r.run_id for r in named.collect()) == ["b", "c"]
    once = redact.extend_ledger(ledger, named)
    assert once.count() == 3 and redact.extend_ledger(once, named).count() == 3


def test_header(spark):
    h = spark.createDataFrame([(["/x/cargo", "build"], "/home", "/home", "/t", "/m", "dev")], "command array<string>, cwd string, workspace_root string, target_dir string, manifest_path string, profile string")
    out = redact.scrub_headers(h)
    assert out.columns == ["command", "profile"] and out.first().command == ["cargo", "<arg>"]


def test_published_phases_only_of_public_crates(spark):
    phases = spark.createDataFrame([("r", "a_b", 1), ("r", "secret", 2), ("q", "a_b", 3)], "run_id string, crate string, samples int")
    crates = spark.createDataFrame([("r", "a-b")], "run_id string, crate string")
    assert [r.samples for r in redact.restrict_to_public(phases, crates).collect()] == [1]


def test_log_text_passes_verbatim_except_for_redaction(spark):
    import json

    from forgeclock.sources import documents

    lines = [
        {"reason": "build-started", "run_id": "r", "cwd": "/h", "workspace_root": "/h", "target_dir": "/t", "manifest_path": "/m", "jobs": 8, "profile": "dev",
         "command": ["/x/cargo", 3, "build", "-Zq"], "new": {"deep": [1, None, "\u00e9"]}},
        {"reason": "unit-registered", "index": 0, "package_id": PUBLIC, "dependencies": [1, 0, 1, "odd"], "target": {"name": "a", "kind": ["lib"]}},
        {"reason": "unit-registered", "index": 1, "package_id": "path+file:///h/secret#0.1"},
        {"reason": "unit-finished", "index": 0, "elapsed": 1.5, "unblocked": 7, "future": 1},
        {"reason": "unit-started", "index": 1, "elapsed": 1},
    ]
    df = spark.createDataFrame([("l", i, json.dumps(x)) for i, x in enumerate(lines)], "log string, pos bigint, t string")
    events = df.select("log", "pos", F.parse_json("t").alias("e"))
    out = {r.pos: json.loads(r.event) for r in redact.redact_log(events).collect()}
    assert set(out) == {0, 1, 3}
    assert out[0] == {"reason": "build-started", "run_id": "r", "jobs": 8, "profile": "dev", "command": ["cargo", "<arg>", "-Zq"], "new": {"deep": [1, None, "\u00e9"]}}
    assert out[1] == {**lines[1], "dependencies": [0, "odd"]}
    assert out[3] == lines[3]
    public = {r.pos: json.loads(r.event) for r in redact.redact_log(events, F.lit(True)).collect()}
    assert public[2]["package_id"] == "workspace#secret@0.1" and public[1]["dependencies"] == [1, 0, 1, "odd"]
    flagged = redact.redact_log(events.withColumn("open", F.lit(True)), F.col("open"))
    assert flagged.count() == 5
    doc = json.loads(documents.documents_from_logs(events, "c 1").first().body)
    assert (doc["run_id"], doc["env"], doc["counts"]) == ("r", {"jobs": 8, "profile": "dev"}, {"events": 3, "units": 1, "sections": 0, "units_withheld": 1})
    assert doc["complete"] is True and [e["reason"] for e in doc["events"]] == ["build-started", "unit-registered", "unit-finished"]
