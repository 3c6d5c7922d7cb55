"""Ordered, per-group sequences: running progress, positions, top-k, retry ledgers.

``running_totals`` numbers rows within a group in a given order without ever
putting one whole group into one task: rows are range-partitioned on
(group, order), each range is numbered locally, and per-range totals (one row
per range and group) become prefix offsets.  The range-partitioned frame is
checkpointed to the shared checkpoint folder so both passes see the same
ranges and a lost executor recomputes from the checkpoint, not the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gauntlet.functions.classify import MAX_ATTEMPTS, backoff_delay, classify_gen_failure, reset_delay
from gauntlet.functions.num import round_to
from gauntlet.session import checkpoint_root


def running_totals(df: DataFrame, groups: list[str], order: list[str], flag: str | None = None,
                   weight: str | None = None, n_ranges: int | None = None) -> DataFrame:
    """Adds ``_pos`` (running sum of ``weight``, 1 per row by default: the 1-based position),
    ``_running`` (running count of ``flag``) and ``_total`` (group sum of ``weight``)."""
    spark = df.sparkSession
    checkpoint_root(spark)  # the session's shared folder; a temporary one only when unset
    n_ranges = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    flag_col = F.col(flag).cast("int") if flag else F.lit(0)
    weight_col = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    ranged = (df.withColumn("_flag", F.coalesce(flag_col, F.lit(0))).withColumn("_w", weight_col)
              .repartitionByRange(n_ranges, *groups, *order)
              .withColumn("_range", F.spark_partition_id())
              .checkpoint(eager=True))
    per_range = ranged.groupBy(*groups, "_range").agg(
        F.sum("_w").alias("_rn"), F.sum("_flag").alias("_rf"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per_range
               .withColumn("_n_before", F.coalesce(F.sum("_rn").over(before), F.lit(0)))
               .withColumn("_f_before", F.coalesce(F.sum("_rf").over(before), F.lit(0)))
               .withColumn("_total", F.sum("_rn").over(Window.partitionBy(*groups)))
               .drop("_rn", "_rf"))
    local_run = Window.partitionBy(*groups, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.join(offsets, [*groups, "_range"])
            .withColumn("_pos", F.col("_n_before") + F.sum("_w").over(local_run))
            .withColumn("_running", F.col("_f_before") + F.sum("_flag").over(local_run))
            .drop("_range", "_n_before", "_f_before", "_flag", "_w"))


def progress_checkpoints(df: DataFrame, groups: list[str], order: list[str], failed: str,
                         every: int) -> DataFrame:
    """``done`` and running ``failures`` in completion order, kept when done % k == 0 or last."""
    rt = running_totals(df, groups, order, failed)
    return (rt.where((F.col("_pos") % every == 0) | (F.col("_pos") == F.col("_total")))
            .withColumnRenamed("_pos", "done").withColumnRenamed("_running", "failures")
            .withColumnRenamed("_total", "total"))


def top_k(df: DataFrame, groups: list[str], order: list, k: int, rank_col: str = "rn") -> DataFrame:
    """First k rows per group; Spark applies the limit per partition before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
            .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def last_write_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Per key the row with the highest ``seq`` (``seq`` is the write order, unique per key).

    The highest ``seq`` per key is a narrow, partially aggregated hash
    aggregate, so a key written very often is reduced map-side; the winning
    rows are then picked with a semi join on (key, seq), which AQE can split
    when one side is skewed.  Wide payloads never enter an aggregation buffer
    nor a sort: the narrow side, one row per key, is hashed and the rows stream
    past it.
    """
    top = df.groupBy(*keys).agg(F.max(seq).alias(seq))
    return df.join(top.hint("shuffle_hash"), [*keys, seq], "left_semi")


def attempt_verdicts(attempts: DataFrame) -> DataFrame:
    """Row-local part of E2: ``ok``, ``terminal``, ``wait_s`` and the ``message`` an item would end with.

    ``ok`` ends with success; a daily-quota rate limit ends with the quota
    message; other rate limits wait for the reset token (else backoff); empty
    replies and 503/529 wait the backoff; other statuses end with the original
    error.
    """
    kind, msg, status = F.col("kind"), F.coalesce(F.col("message"), F.lit("")), F.col("status_code")
    quota = (kind == "rate_limit") & msg.contains("free-models-per-day")
    transient = F.coalesce(status.isin(503, 529), F.lit(False))
    ok = F.coalesce(kind == "ok", F.lit(False))
    terminal = F.coalesce(ok | quota | ((kind == "status") & ~transient), F.lit(False))
    backoff = backoff_delay(F.col("attempt"))
    wait = (F.when(terminal, F.lit(0.0))
            .when(kind == "rate_limit", reset_delay(msg, F.col("at_ms"), backoff))
            .otherwise(backoff))
    final = (F.when(ok, F.lit(None).cast("string"))
             .when(quota, F.concat(F.lit("daily free quota exhausted for this API key: "), msg))
             .otherwise(msg))
    return attempts.withColumns({"ok": ok, "terminal": terminal, "wait_s": wait, "message": final})


def ledger_outcome(last: DataFrame, keys: list[str], max_attempts: int = MAX_ATTEMPTS, *more: str) -> DataFrame:
    """E2 outcome of items from the verdict on their last attempt.

    ``last``: keys, ok, terminal, message, status_code, attempts_used,
    attempts_ignored, total_wait_s.  Without a terminal attempt the item
    failed after all attempts.
    """
    message = (F.when(F.col("ok"), F.lit(None).cast("string"))
               .when(F.col("terminal"), F.col("message"))
               .otherwise(F.concat(F.lit(f"generation failed after {max_attempts} retries: "), F.col("message"))))
    reason = classify_gen_failure(message, F.when(F.col("terminal"), F.col("status_code")))
    return last.select(
        *keys, F.when(F.col("ok"), F.lit("success")).otherwise(F.lit("failed")).alias("outcome"),
        "attempts_used", "attempts_ignored", round_to("total_wait_s", 3).alias("total_wait_s"),
        message.alias("final_message"), F.when(~F.col("ok"), reason).alias("reason"), *more)


def retry_outcome(attempts: DataFrame, keys: list[str], max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Replay the attempt ledger per item (attempts 0..max_attempts-1; later ones are counted as ignored).

    Attempts count up to the first terminal one (``attempt_verdicts``).
    Without one the item fails after all attempts, and the last wait is still
    spent.
    """
    late = (F.col("attempt") >= max_attempts).cast("int")
    a = attempts.withColumn("attempts_ignored", F.sum(late).over(Window.partitionBy(*keys)).cast("int")).where(
        F.col("attempt") < max_attempts)
    # one exchange and one sort: every window below shares (keys, attempt)
    order = Window.partitionBy(*keys).orderBy("attempt")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = (attempt_verdicts(a)
             .withColumn("_ended_before", F.coalesce(F.max(F.col("terminal").cast("int")).over(before), F.lit(0)))
             .where(F.col("_ended_before") == 0))
    last = (steps.withColumn("attempts_used", F.count(F.lit(1)).over(whole).cast("int"))
            .withColumn("total_wait_s", F.sum("wait_s").over(whole))
            .withColumn("_is_last", F.lead("attempt").over(order).isNull())
            .where(F.col("_is_last")))
    return ledger_outcome(last, keys, max_attempts)
