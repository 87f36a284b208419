"""The published queries over the five tables.

``SQL`` is the text users run on the temp views; every ordering is made total so
that a limit always returns the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeclock import schemas
from forgeclock.operators.ordered import with_share
from forgeclock.sources.publication import Publication

SQL = {
    "newest_sessions": """
        SELECT run_id, timestamp, rustc_version, cpu_model, units, complete
        FROM {sessions} ORDER BY timestamp DESC NULLS LAST, run_id""",
    "slowest_units": """
        SELECT package, crate, mode, round(duration, 3) AS seconds
        FROM {units} ORDER BY duration DESC NULLS LAST, package, crate, mode LIMIT 20""",
    "section_totals": """
        SELECT package, round(sum(frontend), 3) AS frontend_seconds, round(sum(codegen), 3) AS codegen_seconds,
               round(sum(link), 3) AS link_seconds
        FROM {units} GROUP BY package
        ORDER BY frontend_seconds + codegen_seconds + link_seconds DESC NULLS LAST, package LIMIT 20""",
    "most_unblocking": """
        SELECT package, sum(unblocked) AS units_unblocked
        FROM {units} GROUP BY package ORDER BY units_unblocked DESC NULLS LAST, package LIMIT 20""",
    "mean_cpu": """
        SELECT run_id, round(avg(cpu_pct), 1) AS mean_cpu_pct
        FROM {timeline} WHERE cpu_pct IS NOT NULL GROUP BY run_id ORDER BY mean_cpu_pct DESC, run_id""",
    "flag_census": """
        SELECT flag, value, count(*) AS units FROM {unit_flags}
        GROUP BY flag, value ORDER BY flag, units DESC, value""",
    "phase_by_package": """
        SELECT package, phase, sum(samples) AS samples FROM {phases}
        WHERE thread = 'serial' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2""",
    "all_units": "SELECT * FROM {units}",
    "cone_total": """
        SELECT sum(m.cpu_s) AS cpu_s
        FROM (SELECT explode(cone_class_ids) AS class_id FROM {classes} WHERE name = {name}) c
        JOIN {measurements} m ON m.class_id = c.class_id""",
}


def run(spark: SparkSession, name: str, **tables: DataFrame | str) -> DataFrame:
    """One published query over the given DataFrames."""
    return spark.sql(SQL[name], **tables)


def serial_phase_share(phases: DataFrame) -> DataFrame:
    """Samples per phase of serial threads and their share of the grand total."""
    grouped = phases.where(F.col("thread") == "serial").groupBy("phase").agg(F.sum("samples").alias("samples"))
    return with_share(grouped, "samples", "share_pct", []).orderBy(F.desc("samples"), "phase")


def create_views(spark: SparkSession, folder: str) -> None:
    """Temp views over the tables of a published folder, as its newest state names them."""
    made = Publication(spark, folder)
    for name in schemas.TABLES:
        if made.has(name):
            made.table(name).createOrReplaceTempView(name)
