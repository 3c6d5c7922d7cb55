"""Streams: late rows behind the watermark are dropped; open windows are not emitted."""

import datetime as dt
import time

from gauntlet.session import scratch_dir
from gauntlet.streaming.progress import progress_stream

DAY = 86400


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, event_type string")


def test_late_rows_dropped_and_open_window_withheld(spark):
    src = scratch_dir(spark, "t-stream")
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    first = _events(spark, [(1, t(10, 5), "error"), (2, t(10, 9), "view"), (3, t(11, 3), "view"),
                            (4, t(12, 6), "error")])
    first.coalesce(1).write.mode("overwrite").parquet(f"{src}/a")
    # the file source takes files in modification order, one per micro-batch
    time.sleep(1.5)
    _events(spark, [(5, t(12, 8), "view")]).coalesce(1).write.mode("overwrite").parquet(f"{src}/b")
    time.sleep(1.5)
    # late rows are judged against the watermark the previous batch ended with (Jan 12 05:00
    # after file a), so this Jan 1 row, two batches later, is dropped; Jan 12 stays open
    _events(spark, [(6, t(1, 0), "error"), (7, t(12, 9), "view")]).coalesce(1).write.mode("overwrite").parquet(
        f"{src}/c")
    out = progress_stream(spark, src + "/*", first.schema)
    got = sorted((r.window_start, r.n, r.failures) for r in out.collect())
    day = lambda d: int(dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc).timestamp())
    assert got == [(day(10), 2, 1), (day(11), 1, 0)]


def test_attempt_stream_matches_batch(spark):
    from sf_paths import SF_SMALL
    from pyspark.sql import functions as F
    from gauntlet.functions.classify import classify_gen_failure
    from gauntlet.sources.tables import fixture
    from gauntlet.streaming.classify import stream_attempt_failures
    batch = (fixture(spark, SF_SMALL, "attempts").where(F.col("kind") != "ok")
             .select("run_id", "item", "attempt", classify_gen_failure("message", "status_code").alias("reason")))
    assert sorted(map(tuple, stream_attempt_failures(spark, SF_SMALL).collect())) == sorted(map(tuple, batch.collect()))
