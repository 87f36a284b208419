"""The five published tables: column order, types and meaning."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1


def _table(columns: list[tuple[str, T.DataType, str]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True, {"comment": c}) for n, t, c in columns])


_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()

UNITS = _table([
    ("run_id", _S, "build this unit belongs to"),
    ("index", _L, "unit number inside the build"),
    ("crate", _S, "target name; all build scripts share one"),
    ("package", _S, "package name taken from package_id"),
    ("mode", _S, "how the unit was run, for instance build or run-custom-build"),
    ("package_id", _S, "package id as logged"),
    ("duration", _D, "finished minus started, seconds"),
    ("started", _D, "timestamp, seconds since the build began"),
    ("finished", _D, "timestamp, seconds since the build began"),
    ("frontend", _D, "wall seconds left after codegen and link; may be below zero"),
    ("codegen", _D, "wall seconds"),
    ("link", _D, "wall seconds"),
    ("unblocked", _L, "how many units this one released"),
])

SESSIONS = _table([
    ("run_id", _S, "build id"),
    ("object_key", _S, "raw document the row came from"),
    ("client", _S, "collecting client and its version"),
    ("schema", _L, "payload version"),
    ("timestamp", _S, "build start, RFC 3339 text"),
    ("rustc_version", _S, "compiler version"),
    ("profile", _S, "build profile"),
    ("jobs", _L, "parallel jobs asked for"),
    ("ci", _B, "ran on a CI host"),
    ("complete", _B, "as many finish events as registrations"),
    ("events", _L, "events kept"),
    ("units", _L, "units kept"),
    ("units_withheld", _L, "private units left out; above zero the graph is partial"),
    ("sections", _L, "section-finish events kept"),
    ("machine_id", _S, "declared by the contributor, unverified"),
    ("os", _S, "operating system"),
    ("arch", _S, "processor architecture"),
    ("cpu_model", _S, "processor name"),
    ("cpu_cores", _L, "cores available"),
    ("mem_gb", _L, "memory, nearest GiB"),
    ("loadavg_mean", _D, "mean load average; null where the host has none"),
    ("cpu_busy_mean", _D, "mean CPU percent"),
])

PHASES = _table([
    ("run_id", _S, "joins to sessions"),
    ("crate", _S, "crate name, underscored"),
    ("package", _S, "name-version of the package"),
    ("crate_type", _S, "lib, bin, proc-macro ..."),
    ("thread", _S, "serial or parallel; never add the two"),
    ("phase", _S, "compiler phase, blocked or unattributed"),
    ("samples", _L, "CPU sample count, not seconds"),
    ("wall_s", _D, "wall seconds of the whole unit"),
    ("rate_hz", _L, "sampling rate"),
    ("sampler", _S, "profiler that made the row"),
])

TIMELINE = _table([
    ("run_id", _S, "joins to sessions"),
    ("t", _D, "seconds since the build began"),
    ("active", _L, "units compiling"),
    ("waiting", _L, "units ready but blocked"),
    ("inactive", _L, "units not yet runnable"),
    ("cpu_pct", _D, "machine CPU percent; set only where the triple is null"),
])

UNIT_FLAGS = _table([
    ("run_id", _S, "joins to sessions"),
    ("crate", _S, "crate name"),
    ("package", _S, "name-version of the package"),
    ("crate_type", _S, "lib, bin, proc-macro ..."),
    ("flag", _S, "compiler setting"),
    ("value", _S, "value as text; never a path"),
])

TABLES: dict[str, T.StructType] = {
    "units": UNITS,
    "sessions": SESSIONS,
    "phases": PHASES,
    "timeline": TIMELINE,
    "unit_flags": UNIT_FLAGS,
}

GRAIN = {
    "units": "compilation unit",
    "sessions": "build",
    "phases": "unit, thread class, phase",
    "timeline": "timeline sample",
    "unit_flags": "unit, setting",
}

CAUTION = {
    "units": "frontend, codegen and link are wall time; do not compare them with phase samples",
    "sessions": "anonymous input: machine_id and hardware are unverified",
    "phases": "CPU sample counts; serial and parallel stay apart",
    "timeline": "concurrency and CPU tick on different clocks; a row carries one or the other",
    "unit_flags": "paths are never kept; incremental is reduced to a yes/no",
}

# Tables that an empty run leaves as they were.
OPTIONAL_TABLES = ("phases", "timeline", "unit_flags")
