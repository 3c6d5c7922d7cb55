"""H2: live failure classification over streams of probe results and generation attempts.

Stateless: the same Column functions as the batch classifiers (kernel
failures, generation failures) run on each micro-batch, and failures go to a
JSONL sink with nulls kept, one overwritten folder per epoch.  The input
table is first landed as parquet files in the shared scratch folder, which
the file source then streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gauntlet.functions.classify import classify_gen_failure, is_hardware_failure, kernel_failure_type
from gauntlet.functions.text import stderr_excerpt
from gauntlet.session import scratch_dir
from gauntlet.sources.tables import fixture


ROWS_PER_FILE = 100_000         # rows of a landed file


def classify_stream(probes: DataFrame) -> DataFrame:
    s = F.lower(F.coalesce(F.col("stderr"), F.lit("")))
    # a probe without a return code did not end well
    typed = probes.where(F.coalesce(F.col("returncode"), F.lit(-1)) != 0).withColumn("failure_type", kernel_failure_type(s))
    return typed.select("run_id", "kernel_id", "seq", "failure_type",
                        is_hardware_failure(F.col("failure_type")).alias("is_hardware_failure"),
                        stderr_excerpt("stderr").alias("stderr_excerpt"))


def classify_attempt_stream(attempts: DataFrame) -> DataFrame:
    """B18 on a stream of generation attempts: every non-ok attempt with its failure reason."""
    failed = attempts.where(F.col("kind") != "ok")
    return failed.select("run_id", "item", "attempt",
                         classify_gen_failure("message", "status_code").alias("reason"))


def stateless_to_sink(stream: DataFrame, transform, sink: str, checkpoint: str, available_now: bool = True):
    """Start ``transform`` on any streaming DataFrame into a JSONL sink (nulls kept); returns the query."""
    def write(batch: DataFrame, epoch: int) -> None:
        # one folder per epoch, overwritten: a replayed epoch rewrites instead of duplicating
        batch.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{sink}/epoch={epoch}")

    writer = (transform(stream).writeStream.outputMode("append").foreachBatch(write)
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_stateless(spark: SparkSession, table: DataFrame, transform, read_schema: str, label: str) -> DataFrame:
    """Land ``table`` as parquet files, stream them through ``transform``, read the JSONL sink back.

    A micro-batch takes a file for every core, and a file has a bounded number
    of rows, so that all cores work however few splits the table has.
    """
    landing = scratch_dir(spark, f"{label}-in")
    table.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(landing)
    files = max(2, spark.sparkContext.defaultParallelism)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(landing)
    sink, ckpt = scratch_dir(spark, f"{label}-out"), scratch_dir(spark, f"{label}-ckpt")
    stateless_to_sink(stream, transform, sink, ckpt).awaitTermination()
    return spark.read.schema(read_schema + ", epoch bigint").json(sink).drop("epoch")


def stream_attempt_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2 for generation attempts."""
    return run_stateless(spark, fixture(spark, sf_dir, "attempts"), classify_attempt_stream,
                         "run_id string, item bigint, attempt int, reason string", "attempts")


def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2 for kernel probes: failing probes classified, read back from the JSONL sink."""
    out = run_stateless(spark, fixture(spark, sf_dir, "probes"), classify_stream,
                        "run_id string, kernel_id string, seq int, failure_type string, "
                        "is_hardware_failure boolean, stderr_excerpt string", "probes")
    return out.select("run_id", "kernel_id", "seq", "failure_type", "is_hardware_failure")
