"""Watermark semantics of the incremental hourly demand."""

import datetime as dt
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq

from slotwise.session import configure
from slotwise.streaming.hourly import run_hourly_demand


def _write(path, times):
    t0 = 1000
    tbl = pa.table(
        {
            "event_id": pa.array(range(t0, t0 + len(times)), pa.int64()),
            "ts": pa.array(times, pa.timestamp("us")),
            "user_id": pa.array([7] * len(times), pa.int64()),
            "event_type": pa.array(["view"] * len(times)),
            "value": pa.array([10.0] * len(times)),
            "props": pa.array(['{"k": 2}'] * len(times)),
        }
    )
    pq.write_table(tbl, path)


def test_late_events_and_watermark(spark):
    configure(spark)
    src = tempfile.mkdtemp(prefix="slotwise-src-")
    out = tempfile.mkdtemp(prefix="slotwise-out-")
    d = dt.datetime(2024, 1, 1)
    _write(os.path.join(src, "events_a.parquet"), [d.replace(minute=10), d.replace(hour=2, minute=10), d.replace(hour=5, minute=10)])
    run_hourly_demand(spark, src, out + "/sink", out + "/ckpt", lateness="1 hour")
    first = {r["hour"].hour: r["demand"] for r in spark.read.parquet(out + "/sink").collect()}
    assert first == {0: 1, 2: 1}  # watermark 04:10 closes the 00h and 02h windows only

    _write(
        os.path.join(src, "events_b.parquet"),
        [d.replace(hour=2, minute=30), d.replace(hour=4, minute=30), d.replace(hour=8, minute=10)],
    )
    run_hourly_demand(spark, src, out + "/sink", out + "/ckpt", lateness="1 hour")
    both = {r["hour"].hour: r["demand"] for r in spark.read.parquet(out + "/sink").collect()}
    # 02:30 arrived after its window closed: dropped; 04:30 was still open: counted.
    # Watermark 07:10 now closes 04h and 05h; 08h stays open.
    assert both == {0: 1, 2: 1, 4: 1, 5: 1}
