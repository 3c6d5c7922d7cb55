"""H1: live progress per event-time window (Structured Streaming).

File source over the events parquet -> event time -> watermark -> tumbling
1-day windows counting completions and failures.  Output mode is ``append``:
a window is emitted once the watermark (latest event time minus one hour)
passes its end, and its state is then dropped, so state stays bounded on an
endless stream.  Rows whose window ended before the watermark the previous
micro-batch finished with are dropped as late (Spark's late-event rule).
``foreachBatch`` writes each micro-batch's closed windows to its own epoch
folder of a parquet sink, overwriting it, so a replayed epoch is idempotent
(nothing collects on the driver); ``availableNow`` drains what is there and
stops, leaving the still-open window unemitted.  The oracle is the batch
twin restricted to closed windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gauntlet.session import scratch_dir
from gauntlet.sources.files import has_files

WINDOW = "1 day"
WATERMARK = "1 hour"


def event_time(ts_ntz) -> F.Column:
    """Wall-clock TIMESTAMP_NTZ -> the UTC instant with that wall clock, whatever the session zone."""
    c = F.col(ts_ntz) if isinstance(ts_ntz, str) else ts_ntz
    micros = (F.unix_date(F.to_date(c)).cast("bigint") * 86_400_000_000
              + F.hour(c).cast("bigint") * 3_600_000_000 + F.minute(c).cast("bigint") * 60_000_000
              + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint"))
    return F.timestamp_micros(micros)


def progress_by_window(events: DataFrame) -> DataFrame:
    return (events.withColumn("event_ts", event_time("ts"))
            .withWatermark("event_ts", WATERMARK)
            .groupBy(F.window("event_ts", WINDOW).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failures")))


def progress_to_sink(events: DataFrame, sink: str, checkpoint: str, available_now: bool = True):
    """Start H1 on any streaming DataFrame of events (event_id, ts, event_type); returns the query.

    Closed windows land in ``sink/epoch=<id>`` (overwritten per epoch, so a
    replayed epoch is idempotent); ``checkpoint`` should sit in the shared folder.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        (batch.select(F.unix_seconds(F.col("w.start")).alias("window_start"), "n", "failures")
         .write.mode("overwrite").parquet(f"{sink}/epoch={epoch}"))

    writer = (progress_by_window(events).writeStream.outputMode("append").foreachBatch(write)
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def progress_stream(spark: SparkSession, src: str, schema, glob: str | None = None) -> DataFrame:
    """Run H1 over the parquet files under ``src`` (one file per micro-batch) and return the closed windows."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    sink, ckpt = scratch_dir(spark, "progress-out"), scratch_dir(spark, "progress-ckpt")
    progress_to_sink(reader.parquet(src), sink, ckpt).awaitTermination()
    if not has_files(spark, sink):  # nothing closed yet
        return spark.createDataFrame([], "window_start bigint, n bigint, failures bigint")
    return spark.read.parquet(sink).select("window_start", F.col("n").cast("bigint").alias("n"),
                                           F.col("failures").cast("bigint").alias("failures"))


def windowed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{src}/events.parquet").schema
    return progress_stream(spark, src, schema, glob="events.parquet")
