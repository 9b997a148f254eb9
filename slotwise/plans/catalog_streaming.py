"""Registered queries: streaming hourly demand (E0 incremental)."""

from __future__ import annotations

from slotwise.plans import common as C
from slotwise.plans.registry import register
from slotwise.streaming.hourly import closed_hours_sql, run_hourly_demand, shared_paths

LATENESS_HOURS = 1


@register(
    "streaming_hourly_demand",
    C.with_ctes(C.CTE_TRIPS, C.CTE_CLEAN, C.CTE_CELLS) + f"SELECT * FROM cells WHERE {closed_hours_sql(LATENESS_HOURS)}",
)
def q_streaming_hourly_demand(spark, sf_dir):
    """E0 as a Structured Streaming job over the events files: every closed
    (zone, hour) window, appended to a Parquet table in the shared folder."""
    sink, checkpoint = shared_paths(spark, "hourly_demand")
    run_hourly_demand(spark, sf_dir, sink, checkpoint, lateness=f"{LATENESS_HOURS} hour")
    return spark.read.parquet(sink)
