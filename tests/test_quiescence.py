"""Outcomes of polled logs: quiet, given up, empty; next to a plain loop over each log."""

import random
from datetime import datetime, timedelta, timezone

from forgeclock.streaming import jobs, quiescence

SECOND = 1_000_000
BEGIN = datetime(2026, 1, 1, tzinfo=timezone.utc)
RULE = quiescence.Rule(quiet=5 * SECOND, cap=30 * SECOND)
SCHEMA = "run_id string, ts timestamp, size bigint"


def plain(polls, rule):
    """Outcome of one log from its (second, size) polls, looking at every second."""
    sizes = dict(sorted(polls))
    start, size, since = min(sizes), None, None
    for t in range(start, start + rule.cap // SECOND):
        if t in sizes and sizes[t] != size:
            size, since = sizes[t], t
        if size > 0 and t - since >= rule.quiet // SECOND:
            return "quiet", t, size
    return ("given up" if size > 0 else "empty"), start + rule.cap // SECOND, size


def watch(spark, tmp_path, parts, rule=RULE):
    arriving, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    seen = []
    for rows in parts:
        data = [(run, BEGIN + timedelta(seconds=t) if t is not None else None, size) for run, t, size in rows]
        spark.createDataFrame(data, SCHEMA).write.mode("append").parquet(arriving)
        quiescence.watch(jobs.file_stream(spark, arriving, spark.createDataFrame([], SCHEMA).schema), out, checkpoint, rule)
        seen.append(named(quiescence.outcomes(spark, out)))
    return seen, named(quiescence.settled(spark, out, rule))


def named(frame):
    begin = int(BEGIN.timestamp())
    return {r["run_id"]: (r["outcome"], r["at"] // SECOND - begin, r["size"]) for r in frame.collect()}


def test_random_logs_in_three_batches(spark, tmp_path):
    rng = random.Random(5)
    logs = {}
    for i in range(40):
        t, size, polls = rng.randrange(10), 0, []
        while t < 60:
            size = size + rng.choice([0, 0, 1, 7]) if i % 4 else 0
            polls.append((t, size))
            t += rng.randint(1, 7 if i % 3 else 2)
        logs[f"r{i}"] = polls
    rows = [(run, t, size) for run, polls in logs.items() for t, size in polls]
    parts = [[r for r in rows if r[1] // 20 == k] for k in range(3)]
    seen, final = watch(spark, tmp_path, parts)
    want = {run: plain(polls, RULE) for run, polls in logs.items()}
    assert final == want
    assert {o for o, _, _ in want.values()} == {"quiet", "given up", "empty"}
    assert seen[0].items() <= seen[1].items() <= seen[2].items() <= want.items() and 0 < len(seen[0]) < len(seen[1])


def test_odd_polls(spark, tmp_path):
    """Nulls, repeated polls, a log that grows after its outcome, and one that is never decided by the stream."""
    first = [("a", 0, 3), ("a", 0, 3), ("a", 0, 2), ("a", 6, 3), ("b", 0, None), ("b", 31, 4), (None, 1, 1), ("c", None, 1), ("d", 29, 9)]
    seen, final = watch(spark, tmp_path, [first, [("a", 32, 8), ("a", 50, 9)]])
    assert seen[0] == {"a": ("quiet", 5, 3), "b": ("empty", 30, 0)}
    assert final == {"a": ("quiet", 5, 3), "b": ("empty", 30, 0), "d": ("quiet", 34, 9)}


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    """The stream dies after its claim and before its commit."""
    rows = [("a", 0, 3), ("b", 0, 1), ("b", 4, 2), ("c", 7, 1)]
    _, before = watch(spark, tmp_path, [rows])
    for mark in (tmp_path / "checkpoint" / "commits").iterdir():
        mark.unlink()
    seen, after = watch(spark, tmp_path, [[("b", 60, 2)]])
    assert after["a"] == before["a"] == ("quiet", 5, 3) and after["b"] == before["b"] == ("quiet", 9, 2)
    assert seen[0] == after
