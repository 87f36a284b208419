"""Build-report pages: matching them to builds and cutting out their data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The embedded constants of a report, and its file name.
BLOCKS = ("UNIT_DATA", "CONCURRENCY_DATA", "CPU_USAGE")
REPORT_PREFIX = "cargo-timing-"
REPORT_SUFFIX = ".html"


def stamp_prefix(started: Column) -> Column:
    """Report name prefix of a build start, cut to the minute; null without a usable time."""
    day = F.replace(F.substring_index(started, "T", 1), F.lit("-"), F.lit(""))
    digits = F.regexp_replace(F.substr(started, F.instr(started, "T") + 1), "[^0-9]", "")
    usable = F.contains(started, F.lit("T")) & (F.length(digits) >= 4)
    return F.when(usable, F.concat(F.lit(REPORT_PREFIX), day, F.lit("T"), F.substr(digits, F.lit(1), F.lit(4))))


def match_reports(builds: DataFrame, reports: DataFrame) -> DataFrame:
    """(run_id, report): the newest report of the build's folder, if it is this build's.

    ``builds`` is (run_id, target_dir, started); ``reports`` is (target_dir, name, modified).
    """
    stamped = reports.where(
        F.startswith("name", F.lit(REPORT_PREFIX)) & F.endswith("name", F.lit(REPORT_SUFFIX))
    )
    newest = stamped.groupBy("target_dir").agg(
        F.max(F.struct("modified", "name")).alias("last")
    ).select("target_dir", F.col("last.name").alias("name"))
    own = F.startswith(F.col("name"), stamp_prefix(F.col("started")))
    return builds.join(newest, "target_dir", "left").select(
        "run_id", F.when(own, F.col("name")).alias("report")
    )


def embedded_block(html: Column, name: str) -> Column:
    """JSON value assigned to ``const NAME`` in a page, as VARIANT; null when absent.

    The JSON reader stops at the end of the first value, so brackets inside strings
    and the script that follows need no scanning of our own.
    """
    marker = f"const {name} = "
    at = F.instr(html, marker)
    start = F.substr(html, at + len(marker))
    opens = F.startswith(start, F.lit("[")) | F.startswith(start, F.lit("{"))
    return F.when((at > 0) & opens, F.from_json(start, "variant", {"mode": "PERMISSIVE"}))


def report_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds one VARIANT column per known block, named in lower case."""
    return pages.withColumns({b.lower(): embedded_block(F.col(html), b) for b in BLOCKS})


def timings_document(pages: DataFrame) -> DataFrame:
    """Adds ``timings``: JSON of the blocks found, null when there is none."""
    names = [b.lower() for b in BLOCKS]
    found = F.filter(
        F.array(
            *[
                F.when(F.col(n).isNotNull(), F.concat(F.lit(f'"{n}":'), F.to_json(n)))
                for n in names
            ]
        ),
        lambda x: x.isNotNull(),
    )
    text = F.concat(F.lit("{"), F.array_join(found, ","), F.lit("}"))
    return pages.withColumn("timings", F.when(F.size(found) > 0, text)).drop(*names)
