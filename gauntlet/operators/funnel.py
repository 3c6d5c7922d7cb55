"""Phase funnel: survivors, failures, probe lookups, the failure dataset and its counts.

Joins run on narrow keys (``run_id``, ``kernel_id``); wide text (stderr,
code) is joined back only for the rows that need it.  The device dimension
is an ordinary join: Spark broadcasts it when its size is below the
session's threshold, and splits skew otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauntlet.functions.classify import is_hardware_failure, kernel_failure_type
from gauntlet.functions.text import stderr_excerpt, strip_embedded_test, assemble_test_module
from gauntlet.operators.progress import last_write_wins, top_k

KEYS = ["run_id", "kernel_id"]


def with_failure_type(df: DataFrame, stderr: str = "stderr", out: str = "failure_type") -> DataFrame:
    """B16 + B17 with ``lower(stderr)`` projected once and read by the whole cascade."""
    return (df.withColumn("_s", F.lower(F.coalesce(F.col(stderr), F.lit(""))))
            .withColumn(out, kernel_failure_type(F.col("_s"))).drop("_s")
            .withColumn("is_hardware_failure", is_hardware_failure(F.col(out))))


def survivors(items: DataFrame, passed) -> DataFrame:
    """Items whose module survived a phase.

    ``passed`` is the phase's listing (run_id, kernel_id): a left semi join, so
    names that the listing repeats, or that no item has, change nothing.  A
    Column is evaluated on the item's own row instead.
    """
    if isinstance(passed, DataFrame):
        return items.join(passed.select(*KEYS), KEYS, "left_semi")
    return items.where(passed)


def phase_failures(candidates: DataFrame, survived: DataFrame) -> DataFrame:
    """Candidates minus survivors; duplicates in ``candidates`` are kept."""
    return candidates.join(survived.select(*KEYS), KEYS, "left_anti")


def probe_lookup(failed: DataFrame, probes: DataFrame) -> DataFrame:
    """C3 + E4: last write per key, then a left lookup with default (-1, '').

    The failing items are hashed and the probes, whose stderr is wide, stream past them unsorted.
    """
    latest = last_write_wins(probes.select(*KEYS, "seq", "returncode", "stderr"), KEYS, "seq")
    return (failed.hint("shuffle_hash").join(latest, KEYS, "left")
            .withColumn("returncode", F.coalesce(F.col("returncode"), F.lit(-1)))
            .withColumn("stderr", F.coalesce(F.col("stderr"), F.lit(""))))


def phase1_records(items: DataFrame, probes: DataFrame, passed1) -> DataFrame:
    """Phase-1 failure records: every item not in the phase-1 survivors."""
    s1 = survivors(items, passed1)
    failed = phase_failures(items.select(*KEYS, "predict"), s1)
    looked = with_failure_type(probe_lookup(failed, probes))
    return looked.select(*KEYS, F.lit(1).alias("phase_failed"), "failure_type", "is_hardware_failure",
                         stderr_excerpt("stderr").alias("stderr_excerpt"),
                         F.col("predict").alias("kernel_code"), "returncode")


def phase2_records(items: DataFrame, probes: DataFrame, passed1, passed2) -> DataFrame:
    """C11: phase-1 survivors missing after phase 2; clean exit -> numerical_mismatch, empty stderr."""
    s1 = survivors(items, passed1)
    s2 = survivors(items, passed2)
    failed = phase_failures(s1.select(*KEYS, "predict", "test"), s2)
    looked = probe_lookup(failed, probes)
    clean = F.col("returncode") == 0
    looked = (looked.withColumn("stderr", F.when(clean, F.lit("")).otherwise(F.col("stderr")))
              .withColumn("_s", F.lower(F.col("stderr")))
              .withColumn("failure_type", F.when(clean, F.lit("numerical_mismatch"))
                          .otherwise(kernel_failure_type(F.col("_s"))))
              .withColumn("is_hardware_failure", is_hardware_failure(F.col("failure_type"))))
    # the phase-1 file holds code + separator + test; phase 2 keeps the code part
    raw = strip_embedded_test(assemble_test_module(F.col("predict"), F.col("test")))
    return looked.select(*KEYS, F.lit(2).alias("phase_failed"), "failure_type", "is_hardware_failure",
                         stderr_excerpt("stderr").alias("stderr_excerpt"), raw.alias("kernel_code"),
                         "returncode")


def latest_probes(probes: DataFrame) -> DataFrame:
    """E4 for the failure dataset: the last probe of each key.

    Rows that a later one overwrites are dropped before the shuffle (group
    limit), so a key written very often does not reach one task.  The rows
    arrive dealt by key, as the join with the failing items needs them.
    """
    return top_k(probes.select(*KEYS, "seq", "returncode", "stderr"), KEYS, [F.col("seq").desc()], 1).drop("seq", "rn")


def failure_dataset(items, probes, devices, passed1, passed2) -> DataFrame:
    """G2 + C7 as one keyed pipeline (8 fields + run).

    The failing items and the latest probe per key are each shuffled once on
    (run_id, kernel_id) for one left join.  The rules read a stderr only after
    it: overwritten probes and those of passing items are not classified, and
    the work is dealt over all shuffle partitions, however few files the
    probes came from.  An item not passing phase 1 failed
    phase 1; one passing phase 1 but not phase 2 failed phase 2.  Missing
    probes read as (-1, ''), a clean phase-2 exit as numerical_mismatch with no stderr.
    """
    # the survivor predicates are evaluated on each item row (one item per key), so no self-join is needed;
    # survivor listings given as tables are turned into such flags by ``jobs.evaluation_report``
    staged = (items.select(*KEYS, "predict", "test", F.coalesce(passed1, F.lit(False)).alias("_p1"),
                           F.coalesce(passed2, F.lit(False)).alias("_p2"))
              .withColumn("phase_failed", F.when(~F.col("_p1"), F.lit(1)).when(~F.col("_p2"), F.lit(2)))
              .where(F.col("phase_failed").isNotNull())
              .join(latest_probes(probes), KEYS, "left"))
    rc = F.coalesce(F.col("returncode"), F.lit(-1))
    clean2 = (F.col("phase_failed") == 2) & (rc == 0)
    staged = staged.withColumn("_s", F.lower(F.coalesce(F.col("stderr"), F.lit(""))))
    ftype = F.when(clean2, F.lit("numerical_mismatch")).otherwise(kernel_failure_type(F.col("_s")))
    excerpt = F.when(clean2, F.lit("")).otherwise(stderr_excerpt("stderr"))
    code = F.when(F.col("phase_failed") == 1, F.col("predict")).otherwise(
        strip_embedded_test(assemble_test_module(F.col("predict"), F.col("test"))))
    recs = staged.select(*KEYS, "phase_failed", ftype.alias("failure_type"), excerpt.alias("stderr_excerpt"),
                         code.alias("kernel_code"), rc.alias("returncode"))
    return (recs.withColumn("is_hardware_failure", is_hardware_failure(F.col("failure_type")))
            .join(devices, "run_id", "left")
            .select("run_id", "kernel_id", "gpu", "compute_cap", "phase_failed", "failure_type",
                    "is_hardware_failure", "stderr_excerpt", "kernel_code", "returncode"))


def failure_analysis(failures: DataFrame, groups=("run_id",)) -> DataFrame:
    """Total / hardware-vs-code / by-type counts in one GROUPING SETS pass (long form)."""
    g = list(groups)
    sets = [g, g + ["is_hardware_failure"], g + ["failure_type"]]
    agg = (failures.groupingSets(sets, *g, "is_hardware_failure", "failure_type")
           .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid")))
    # grouping_id bits (hw, type): 3 = per group only, 1 = hardware split, 2 = by type
    gid = F.col("_gid")
    return agg.select(
        *g,
        F.when(gid == 3, F.lit("total")).when(gid == 1, F.lit("split")).otherwise(F.lit("by_type")).alias("grouping"),
        F.when(gid == 3, F.lit("all"))
        .when(gid == 2, F.col("failure_type"))
        .when(F.col("is_hardware_failure"), F.lit("hardware")).otherwise(F.lit("code")).alias("key"),
        F.col("n").cast("bigint").alias("n"),
    )


def fallback_union(primary: DataFrame, fallback: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``primary``, or ``fallback`` where ``primary`` is empty (per ``keys`` group if given)."""
    if keys:
        present = primary.select(*keys).distinct()
        return primary.unionByName(fallback.join(present, keys, "left_anti"))
    # whole-relation form: a one-row emptiness probe picks the side, no keyless join
    return fallback if primary.isEmpty() else primary
