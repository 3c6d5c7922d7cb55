"""Composite jobs on caller-supplied tables.

Each job takes DataFrames (whatever the acting side produced: replies,
probe rows, survivor listings, stdout lines, timings, source files) and
returns DataFrames; nothing is collected.  The catalog runs them on the
fixtures; users run them on their own tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gauntlet.functions import classify as C
from gauntlet.functions import text as X
from gauntlet.functions.num import round_to
from gauntlet.functions.pyparse import python_parse_status
from gauntlet.operators import efficiency as EF
from gauntlet.operators import funnel as FN
from gauntlet.operators import progress as PG
from gauntlet.operators import stats as ST
from gauntlet.operators import variants as V
from gauntlet.session import checkpoint_root

# ---- fixed values (must equal the evaluated pipeline's) -------------------
EMPTY_REPLY_MESSAGE = "generation failed after 2 retries: API returned empty content (model at capacity)"
SYNTAX_MESSAGE_PREFIX = "SyntaxError after fence-strip — raw preview: "
# ---------------------------------------------------------------------------

# ------------------------------------------------------------------ J1

def _head(df: DataFrame, limit: int | None, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The first ``limit`` rows by ``order`` (of each group of ``keys``); all without a limit."""
    if limit is None:
        return df
    return PG.top_k(df, list(keys), list(order), limit).drop("rn") if keys else df.orderBy(*order).limit(limit)


def generation_items(replies: DataFrame, limit: int | None = None, order: Sequence[str] = ("idx",),
                     keys: Sequence[str] = ()) -> DataFrame:
    """J1 per item: the prediction (code, or a failure stub) and the item's meta.

    ``replies``: reply, latency_s, completion_tokens, finish_reason, optionally
    prompt_tokens (+ any key columns, kept).  A blank reply fails as an empty response with no
    telemetry; a reply whose extracted code does not parse fails as a syntax
    error but keeps its telemetry.  The parser (the only Python) runs on
    non-blank replies only.  With ``limit`` a run stops after its first tasks:
    only the first rows by ``order`` (of each group of ``keys``) are taken,
    before any text is read.
    """
    replies = _head(replies, limit, order, keys)
    blank = X.ustrip(F.coalesce(F.col("reply"), F.lit(""))) == ""
    code = X.extract_code("reply")
    # a null argument is not parsed; a condition around the call would not keep rows from the parser
    staged = replies.withColumn("_code", code).withColumn("_status", python_parse_status(F.when(~blank, F.col("_code"))))
    if "prompt_tokens" not in staged.columns:
        staged = staged.withColumn("prompt_tokens", F.lit(None).cast("bigint"))
    message = (F.when(blank, F.lit(EMPTY_REPLY_MESSAGE))
               .when(F.col("_status") == "syntax",
                     F.concat(F.lit(SYNTAX_MESSAGE_PREFIX), X.python_repr(X.reply_preview("reply"))))
               .when(F.col("_status") == "other", F.lit("unexpected parser error")))
    return (staged.withColumn("_message", message)
            .withColumn("fail_reason", F.when(F.col("_message").isNotNull(), C.classify_gen_failure("_message")))
            .withColumn("predict", F.when(F.col("_message").isNotNull(), X.failed_stub("_message"))
                        .otherwise(F.col("_code")))
            .withColumn("latency_s", F.when(~blank, round_to("latency_s", 3)))
            .withColumn("completion_tokens", F.when(~blank, F.col("completion_tokens")))
            .withColumn("prompt_tokens", F.when(~blank, F.col("prompt_tokens")))
            .withColumn("truncated", ~blank & C.truncated_flag("finish_reason"))
            .withColumn("finish_reason", F.when(~blank, F.col("finish_reason")))
            .drop("_code", "_status", "_message"))


def generation_report(replies: DataFrame, keys=("model",), limit: int | None = None,
                      order: Sequence[str] = ("idx",)) -> DataFrame:
    """Per-group report over ``generation_items``: failures by reason, latency, tokens, truncation.

    With ``limit`` each group's first rows by ``order`` count.
    """
    keys = list(keys)
    checkpoint_root(replies.sparkSession)
    # four aggregations read the items: materialise the narrow columns once (reliable checkpoint in the
    # shared folder) instead of re-running extraction and the parser for each of them
    staged = (generation_items(replies, limit, order, keys)
              .select(*keys, "latency_s", "completion_tokens", "prompt_tokens", "finish_reason", "fail_reason")
              .checkpoint(eager=True))
    tele = ST.generation_telemetry(staged, keys)
    pct = ST.latency_percentiles(staged, keys, "latency_s").drop("n")
    hist = (ST.histogram_text(staged.where(F.col("fail_reason").isNotNull()), keys, "fail_reason", "by_reason")
            .select(*keys, F.col("by_reason_text").alias("failures_by_reason")))
    tot = staged.groupBy(*keys).agg(F.count_if(F.col("fail_reason").isNotNull()).alias("failures_total"),
                                    F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("bigint").alias("total_prompt"))
    return (tele.join(pct, keys).join(tot, keys).join(hist, keys, "left")
            .select(*keys, "n_items", "failures_total", "failures_by_reason", F.col("p50").alias("latency_p50"),
                    F.col("p95").alias("latency_p95"), "latency_mean", "total_prompt", "total_completion",
                    "mean_completion", "truncated_count"))


def generation_document(report: DataFrame, keys=("model",)) -> DataFrame:
    """A10: the nested generation document per group from ``generation_report`` (JSON, nulls kept)."""
    keys = list(keys)
    generation = F.struct(
        "n_items",
        F.struct(F.col("latency_p50").alias("p50"), F.col("latency_p95").alias("p95"),
                 F.col("latency_mean").alias("mean")).alias("latency_s"),
        F.struct(F.col("failures_total").alias("total"), ST.text_map(F.col("failures_by_reason")).alias("by_reason"))
        .alias("failures"),
        F.struct("total_prompt", "total_completion", "mean_completion").alias("tokens"),
        "truncated_count")
    doc = F.struct(*keys, generation.alias("generation"))
    return report.select(*keys, F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


#: What a reader of the generation documents gets (per run).
_long, _double = T.LongType(), T.DoubleType()
GENERATION_SCHEMA = T.StructType().add("run_id", T.StringType()).add(
    "generation", T.StructType().add("n_items", _long)
    .add("latency_s", T.StructType().add("p50", _double).add("p95", _double).add("mean", _double))
    .add("failures", T.StructType().add("total", _long).add("by_reason", T.MapType(T.StringType(), _long)))
    .add("tokens", T.StructType().add("total_prompt", _long).add("total_completion", _long).add("mean_completion", _double))
    .add("truncated_count", _long))


def generation_sidecar(replies: DataFrame, keys=("run_id",)) -> DataFrame:
    """The ``generation`` block J2 reads, from J1's items: blank replies have no telemetry."""
    keys = list(keys)
    return generation_report(replies, keys).select(
        *keys, F.col("latency_p50").alias("gen_latency_p50"), F.col("latency_p95").alias("gen_latency_p95"),
        F.col("total_completion").alias("gen_total_completion"),
        F.coalesce("failures_by_reason", F.lit("")).alias("gen_failures_by_reason"))


def generation_from_documents(documents: DataFrame) -> DataFrame:
    """The same block from generation documents read with ``GENERATION_SCHEMA`` (the sidecar files of J1).

    ``documents``: run_id and the ``generation`` struct; unreadable ones (a null run) are left out.
    """
    g = F.col("generation")
    return documents.where(F.col("run_id").isNotNull()).select(
        "run_id", g["latency_s"]["p50"].alias("gen_latency_p50"), g["latency_s"]["p95"].alias("gen_latency_p95"),
        g["tokens"]["total_completion"].alias("gen_total_completion"),
        F.coalesce(ST.map_text(g["failures"]["by_reason"]), F.lit("")).alias("gen_failures_by_reason"))


# ------------------------------------------------------------------ J2 / J4

def run_counts(items: DataFrame, passed1: Column, passed2: Column) -> DataFrame:
    """D1 + D2 counts in one aggregation over the items."""
    stub = X.is_failed_stub("predict")
    return items.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(stub).alias("generation_failures"),
        F.count_if(~stub).alias("usable_predictions"),
        F.count_if(passed1).alias("phase1_passed"),
        F.count_if(passed2).alias("phase2_passed"))


def funnel_rates(counts: DataFrame) -> DataFrame:
    """Rates (2 digits); total 0 -> 0; among phase 1 null when none passed."""
    rate = lambda num, den: round_to(F.try_divide(F.col(num) * 100.0, F.nullif(F.col(den), F.lit(0))), 2)  # noqa
    return (counts.withColumn("phase1_rate", F.coalesce(rate("phase1_passed", "total_predictions"), F.lit(0.0)))
            .withColumn("phase2_rate", F.coalesce(rate("phase2_passed", "total_predictions"), F.lit(0.0)))
            .withColumn("phase2_rate_among_phase1", rate("phase2_passed", "phase1_passed")))


def _survivor_flags(items: DataFrame, *listings):
    """Turn survivor listings (DataFrames of run_id, kernel_id) into flag columns on the items.

    A listing that is already a Column (a predicate on the items) is used as is.
    Listings are de-duplicated key sets, joined on the item keys.
    """
    flags = []
    for i, listing in enumerate(listings):
        if isinstance(listing, DataFrame):
            name = f"_survived{i}"
            keys = listing.select(*FN.KEYS).distinct().withColumn(name, F.lit(True))
            items = items.join(keys, FN.KEYS, "left")
            flags.append(F.coalesce(F.col(name), F.lit(False)))
        else:
            flags.append(listing)
    return (items, *flags)


def evaluation_report(items: DataFrame, probes: DataFrame, devices: DataFrame, passed1: Column, passed2: Column,
                      lines: DataFrame, line_order: list[str], generation: DataFrame | None = None,
                      runlogs: DataFrame | None = None, phase_log: DataFrame | None = None) -> DataFrame:
    """J2 (and J4 when ``generation`` is None): one flat summary row per run.

    ``items``: run_id, kernel_id, predict, test; ``passed1`` / ``passed2``: the
    phase survivor listings, either DataFrames of (run_id, kernel_id) or
    Columns evaluated on the items; ``probes``: run_id, kernel_id, seq, returncode, stderr;
    ``devices``: run_id, gpu, compute_cap; ``lines``: run_id, ``line_order``
    columns, line and optionally stream (``stdout`` or ``stderr``): what the
    phase-3 speed-up tool wrote; ``generation``: run_id and the
    ``generation_sidecar`` columns, or None for bring-your-own predictions;
    ``runlogs``: run_id, returncode, duration_s of each perf script;
    ``phase_log``: run_id, phase, started_s, ended_s.

    With ``runlogs`` the phase-3 block is gated as the scripts went: a run
    without survivors, or whose scripts were all skipped, was not measured.
    It has no speed-ups and the reason as its output.  Without ``runlogs``
    every run with lines counts as measured.
    """
    items, passed1, passed2 = _survivor_flags(items, passed1, passed2)
    base = funnel_rates(run_counts(items, passed1, passed2))
    status = None
    if runlogs is not None:
        status = EF.perf_completion(base.select("run_id", F.col("phase2_passed").alias("survivors")), runlogs)
        # a row per run: shuffled by run, the lines of a few runs would go to as few tasks
        lines = lines.join(F.broadcast(status.where(F.col("status") == EF.MEASURED).select("run_id")), "run_id", "left_semi")
    if "stream" not in lines.columns:
        lines = lines.withColumn("stream", F.lit("stdout"))
    stdout = lines.where(F.col("stream") == "stdout")
    ratios = ST.ratio_stats(EF.parse_speedups(stdout), ["run_id"], "ratio").drop("n_nonpositive")
    mean = EF.reported_mean(stdout, ["run_id"], line_order)
    tails = EF.output_tails(lines, ["run_id"], line_order)
    # one pass over the failure dataset: counts per (run, type, hardware), then both summaries
    per_type = (FN.failure_dataset(items, probes, devices, passed1, passed2)
                .groupBy("run_id", "failure_type", "is_hardware_failure").agg(F.count(F.lit(1)).alias("_n")))
    fa = per_type.groupBy("run_id").agg(
        F.sum("_n").alias("total_failures"),
        F.coalesce(F.sum(F.when(F.col("is_hardware_failure"), F.col("_n"))), F.lit(0)).alias("hardware_failures"),
        ST.map_text(F.map_from_entries(F.collect_list(F.struct("failure_type", "_n")))).alias("failures_by_type"))
    out = base.join(mean, "run_id", "left").join(ratios, "run_id", "left").join(fa, "run_id", "left").join(
        tails, "run_id", "left")
    if status is not None:
        out = out.join(status.select("run_id", "n_scripts", "n_skipped", F.col("status").alias("phase3_status")), "run_id", "left")
    else:
        out = out.withColumns({"n_scripts": F.lit(None).cast("bigint"), "n_skipped": F.lit(None).cast("bigint"), "phase3_status": F.when(
            F.col("raw_output_tail").isNotNull(), F.lit(EF.MEASURED))})
    if phase_log is not None:
        out = out.join(EF.phase_timings(phase_log), "run_id", "left")
    else:
        out = out.withColumns({f"{p}_s": F.lit(None).cast("double") for p in EF.PHASES})
    if generation is not None:
        out = out.join(generation, "run_id", "left")
    else:
        out = (out.withColumn("gen_latency_p50", F.lit(None).cast("double"))
               .withColumn("gen_latency_p95", F.lit(None).cast("double"))
               .withColumn("gen_total_completion", F.lit(None).cast("bigint"))
               .withColumn("gen_failures_by_reason", F.lit(None).cast("string")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    total, hw = F.coalesce(F.col("total_failures"), F.lit(0)), F.coalesce(F.col("hardware_failures"), F.lit(0))
    return out.select(
        "run_id", "total_predictions", "generation_failures", "usable_predictions",
        "phase1_passed", "phase1_rate", "phase2_passed", "phase2_rate", "phase2_rate_among_phase1",
        "mean_speedup", zero("n_kernels_measured"), "geomean_speedup", "median_speedup", "min_speedup",
        "max_speedup", "pct_faster_than_pytorch", zero("total_failures"), zero("hardware_failures"),
        (total - hw).cast("bigint").alias("code_failures"),
        F.coalesce(F.col("failures_by_type"), F.lit("")).alias("failures_by_type"),
        "gen_latency_p50", "gen_latency_p95", "gen_total_completion", "gen_failures_by_reason",
        "n_scripts", "n_skipped", "phase3_status",
        F.when(F.col("phase3_status") != EF.MEASURED, F.col("phase3_status"))
        .otherwise(F.coalesce("raw_output_tail", F.lit(""))).alias("raw_output_tail"),
        *(f"{p}_s" for p in EF.PHASES))


def summary_document(report: DataFrame) -> DataFrame:
    """A10: the nested per-run summary document (JSON text, null fields kept) from ``evaluation_report``.

    ``failure_analysis.by_type`` is a JSON object; ``generation`` is null when
    the run has no generation telemetry (bring-your-own predictions).
    """
    by_type = ST.text_map(F.col("failures_by_type"))
    has_gen = F.col("gen_latency_p50").isNotNull() | F.col("gen_total_completion").isNotNull()
    generation = F.when(has_gen, F.struct(
        F.struct(F.col("gen_latency_p50").alias("p50"), F.col("gen_latency_p95").alias("p95")).alias("latency_s"),
        F.struct(F.col("gen_total_completion").alias("total_completion")).alias("tokens"),
        F.struct(ST.text_map(F.col("gen_failures_by_reason")).alias("by_reason")).alias("failures")))
    doc = F.struct(
        "run_id", "total_predictions", "generation_failures", "usable_predictions",
        F.struct(F.col("phase1_passed").alias("passed"), F.col("phase1_rate").alias("rate")).alias("phase1_call_acc"),
        F.struct(F.col("phase2_passed").alias("passed"), F.col("phase2_rate").alias("rate"),
                 F.col("phase2_rate_among_phase1").alias("rate_among_phase1")).alias("phase2_exec_acc"),
        F.struct("mean_speedup", "n_kernels_measured", "geomean_speedup", "median_speedup", "min_speedup",
                 "max_speedup", "pct_faster_than_pytorch", "raw_output_tail").alias("phase3_efficiency"),
        F.struct(*(f"{p}_s" for p in EF.PHASES)).alias("timing_s"),
        generation.alias("generation"),
        F.struct("total_failures", "hardware_failures", "code_failures", by_type.alias("by_type"))
        .alias("failure_analysis"))
    return report.select("run_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


# ------------------------------------------------------------------ J3

def mutation_report(corpus: DataFrame, outcomes: DataFrame, timings: DataFrame, devices: list[tuple[str, str]],
                    registry=V.DEFAULT_REGISTRY, checkpoint: bool = False, limit: int | None = None) -> dict[str, DataFrame]:
    """The mutation dataset, its per-device summary and totals, the skip rows, and the summary document.

    ``corpus``: kernel_id, path, source; ``outcomes``: kernel_id,
    mutation_type, gpu, compute_cap, returncode, stdout, stderr (at most one row
    per kernel, mutation and device that was run); ``timings``: kernel_id, side,
    sample_ms; ``devices``: the (gpu, compute_cap) pairs of the run.  Every
    kernel and mutation counts as attempted on every device.  With ``limit``
    only the first source files by path take part.
    Outputs are lazy and each recomputes the rewrites and the parser; with
    ``checkpoint=True`` the attempts are materialised once for callers that
    use several outputs.
    """
    gated = V.with_parse_gate(V.expand_registry(_head(corpus, limit, ["path", "kernel_id"]), registry))
    attempts = V.attempt_rows(gated, outcomes, timings, devices)
    if checkpoint:
        # several outputs read the attempts: write them once to the shared checkpoint folder
        checkpoint_root(corpus.sparkSession)
        attempts = attempts.checkpoint(eager=True)
    skips = gated.where(F.col("skip_reason").isNotNull()).select(
        "kernel_id", "mutation_type", F.col("skip_reason").alias("reason"))
    summary = V.mutation_summary(attempts)
    totals = attempts.groupBy("gpu", "compute_cap").agg(
        F.countDistinct("kernel_id").alias("total_kernels_processed"),
        F.count(F.lit(1)).alias("total_mutations_attempted"),
        F.count_if("applicable").alias("total_mutations_applicable"))
    return {"rows": V.mutation_rows(attempts), "summary": summary, "skips": skips, "totals": totals,
            "document": mutation_summary_document(summary, totals)}


def mutation_summary_document(summary: DataFrame, totals: DataFrame) -> DataFrame:
    """A10: the per-device mutation summary document (JSON, nulls kept).

    ``by_mutation`` holds one entry per registry mutation, so collecting it per
    device is bounded; the skip rows stay a table of their own (``skips``)
    rather than an unbounded list inside one document.
    """
    entry = F.struct("attempted", "applicable", "validated", "validation_rate", "applicability_rate")
    by_mut = summary.groupBy("gpu", "compute_cap").agg(
        F.map_from_entries(F.collect_list(F.struct("mutation_type", entry))).alias("by_mutation"))
    doc = F.struct("gpu", "compute_cap", "total_kernels_processed", "total_mutations_attempted",
                   "total_mutations_applicable", "by_mutation")
    return (totals.join(by_mut, ["gpu", "compute_cap"])
            .select("gpu", "compute_cap", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document")))
