"""Variant corpora: corpus x registry, skip rows, outcomes, mutation dataset and summary.

The corpus x registry product is row-local (``explode`` of an array of
structs built from the registry), so source text never shuffles until it is
joined with outcomes, and that join runs on narrow keys.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from gauntlet.functions.num import round_to

from gauntlet.functions.classify import (
    BEHAVIOR_FAIL_BLOCK_SIZE, BEHAVIOR_FAIL_DTYPE, BEHAVIOR_FAIL_SHARED_MEM, BEHAVIOR_RUNS_NO_BF16,
    actual_behavior, failure_to_behavior, kernel_failure_type, mutation_hardware_flag, predict_by_device,
)
from gauntlet.functions.pyparse import python_parse_status
from gauntlet.functions.rewrite import (
    NO_TEST_FUNCTION_MESSAGE, test_function_name, timing_token, variant_bf16, variant_fp8,
    variant_non_pow2, variant_shared_mem,
)
from gauntlet.functions.text import stderr_excerpt
from gauntlet.operators.stats import upper_median


@dataclass(frozen=True)
class Variant:
    """One registry entry; ``rewrite`` maps a source Column (or text, if ``python``) to the variant or null."""
    name: str
    rewrite: Callable
    predicted: str
    is_perf: bool
    python: bool = False


#: What the registry adds to a row of the corpus.
EXPANDED = T.StructType([
    T.StructField("mutation_type", T.StringType()), T.StructField("pos", T.IntegerType()),
    T.StructField("predicted", T.StringType()), T.StructField("is_perf", T.BooleanType()),
    T.StructField("variant", T.StringType()), T.StructField("error", T.StringType())])

# ---- fixed values: registry order and predictions, skip reasons -----------
SKIP_NOT_APPLICABLE = "not applicable"
SKIP_PARSE_FAILED = "ast.parse failed after mutation"
SKIP_MUTATOR_ERROR = "mutator error: "
DEFAULT_REGISTRY = [
    Variant("shared_mem_overflow", variant_shared_mem, BEHAVIOR_FAIL_SHARED_MEM, False),
    Variant("force_fp8", variant_fp8, BEHAVIOR_FAIL_DTYPE, False),
    Variant("force_bf16", variant_bf16, BEHAVIOR_RUNS_NO_BF16, True),
    Variant("non_pow2_block", variant_non_pow2, BEHAVIOR_FAIL_BLOCK_SIZE, False),
]
# ---------------------------------------------------------------------------


def python_variant(name: str, fn: Callable[[str], str | None], predicted: str, is_perf: bool) -> Variant:
    """A registry entry whose ``rewrite`` is a user's Python function: source text -> variant, or None if it does not apply.

    ``fn`` is shipped by value and runs in the tasks.  An exception becomes a
    ``mutator error`` skip of that (kernel, mutation), not a failed job.  A
    result that is not text is an error too.
    """
    return Variant(name, fn, predicted, is_perf, python=True)


def mutator_table(entries: list[tuple[int, Variant]]):
    """The user mutators as one table function: source -> a row (mutation_type, pos, predicted, is_perf, variant, error) each.

    Arrow batches carry rows both ways.  A call sees one source and yields its
    rows one after another, so a worker holds one variant at a time.  A null
    source gives a row without a variant for every mutator.
    """
    plan = [(v.name, pos, v.predicted, v.is_perf, v.rewrite) for pos, v in entries]

    class Mutators:
        def eval(self, source):
            for name, pos, predicted, is_perf, fn in plan:
                variant = error = None
                try:
                    variant = None if source is None else fn(source)
                    if variant is not None and not isinstance(variant, str):
                        variant, error = None, f"returned {type(variant).__name__}, not text"
                except Exception as exc:  # noqa: BLE001 - user code, captured per row
                    error = str(exc)
                yield name, pos, predicted, is_perf, variant, error

    return F.udtf(Mutators, returnType=EXPANDED, useArrow=True)


def expand_registry(corpus: DataFrame, registry=DEFAULT_REGISTRY, source: str = "source") -> DataFrame:
    """Corpus x registry, row-local; adds mutation_type, pos, predicted, is_perf, variant, error.

    Column rewrites are exploded from an array of structs; user mutators come
    from a lateral join with ``mutator_table``, which runs each of them once per
    row.  A registry with both reads the corpus once for either kind.
    """
    native = [(pos, v) for pos, v in enumerate(registry) if not v.python]
    python = [(pos, v) for pos, v in enumerate(registry) if v.python]
    parts = []
    if native or not python:
        entries = [F.struct(F.lit(v.name).alias("mutation_type"), F.lit(pos).alias("pos"),
                            F.lit(v.predicted).alias("predicted"), F.lit(v.is_perf).alias("is_perf"),
                            v.rewrite(F.col(source)).alias("variant"), F.lit(None).cast("string").alias("error"))
                   for pos, v in native]
        # the cast gives an empty registry its columns
        array = F.array(*entries).cast(T.ArrayType(EXPANDED))
        parts.append(corpus.withColumn("_m", F.explode(array)).select("*", "_m.*").drop("_m"))
    if python:
        parts.append(corpus.lateralJoin(mutator_table(python)(F.col(source).outer())))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def with_parse_gate(expanded: DataFrame) -> DataFrame:
    """Skip reason per (kernel, mutation); the parser runs only on applicable variants."""
    applicable = F.col("error").isNull() & F.col("variant").isNotNull()
    # a null argument is not parsed; a condition around the call would not keep rows from the parser
    status = python_parse_status(F.when(applicable, F.col("variant")))
    reason = (F.when(F.col("error").isNotNull(), F.concat(F.lit(SKIP_MUTATOR_ERROR), F.col("error")))
              .when(F.col("variant").isNull(), F.lit(SKIP_NOT_APPLICABLE))
              .when(F.col("_parse") != "ok", F.lit(SKIP_PARSE_FAILED)))
    return expanded.withColumn("_parse", status).withColumn("skip_reason", reason).drop("_parse")


def attempt_rows(gated: DataFrame, outcomes: DataFrame, timings: DataFrame, devices: list[tuple[str, str]]) -> DataFrame:
    """Every attempted (kernel, mutation, device) with the J3 fields and an ``applicable`` flag.

    ``devices``: the (gpu, compute_cap) pairs, exploded row by row.  A variant
    that does not apply is never run and has no outcome, yet counts as
    attempted; an applicable one without an outcome reads as (-1, '').
    """
    pairs = F.array(*[F.struct(F.lit(gpu).alias("gpu"), F.lit(cap).alias("compute_cap")) for gpu, cap in devices])
    per_dev = gated.withColumn("_d", F.explode(pairs)).select("*", "_d.*").drop("_d")
    per_dev = per_dev.join(outcomes, ["kernel_id", "mutation_type", "gpu", "compute_cap"], "left").withColumn(
        "returncode", F.coalesce("returncode", F.lit(-1)))
    predicted, is_perf = predict_by_device(F.col("mutation_type"), F.col("predicted"), F.col("is_perf"),
                                           F.col("compute_cap"))
    per_dev = per_dev.withColumn("predicted", predicted).withColumn("is_perf", is_perf)
    baseline = (upper_median(timings.where(F.col("side") == "baseline"), ["kernel_id"], "sample_ms")
                .select("kernel_id", F.col("upper_median").alias("_baseline_ms")))
    has_test = test_function_name(F.col("variant")).isNotNull()
    joined = per_dev.join(baseline, "kernel_id", "left")
    # a perf variant without a test function cannot be timed: rc -1 with a message
    perf_no_test = F.col("is_perf") & ~has_test
    rc = F.when(perf_no_test, F.lit(-1)).otherwise(F.col("returncode"))
    err = F.when(perf_no_test, F.lit(NO_TEST_FUNCTION_MESSAGE)).otherwise(F.coalesce(F.col("stderr"), F.lit("")))
    base_has_test = test_function_name(F.col("source")).isNotNull()
    baseline_ms = F.when(F.col("is_perf") & base_has_test, F.col("_baseline_ms"))
    staged = (joined.withColumn("_rc", rc).withColumn("_err", err)
              .withColumn("_s", F.lower(F.col("_err")))
              .withColumn("_ft", F.when(F.col("_rc") != 0, kernel_failure_type(F.col("_s"))))
              .withColumn("_base", baseline_ms)
              .withColumn("_mut", F.when(F.col("is_perf") & (F.col("_rc") == 0), timing_token(F.col("stdout")))))
    behavior_on_failure = failure_to_behavior(F.col("_ft"), F.col("_err"))
    actual = actual_behavior(F.col("is_perf"), F.col("predicted"), F.col("_rc"), behavior_on_failure,
                             F.col("_mut"), F.col("_base"))
    staged = staged.withColumn("actual_behavior", actual)
    return staged.select(
        F.col("skip_reason").isNull().alias("applicable"),
        "kernel_id",
        F.col("path").alias("original_kernel_path"),
        "mutation_type", "gpu", "compute_cap",
        F.col("predicted").alias("predicted_behavior"),
        "actual_behavior",
        (F.col("actual_behavior") == F.col("predicted")).alias("validated"),
        F.col("_ft").alias("failure_type"),
        mutation_hardware_flag(F.col("_ft"), F.col("actual_behavior")).alias("is_hardware_failure"),
        stderr_excerpt(F.col("_err")).alias("stderr_excerpt"),
        F.when(F.col("is_perf"), round_to("_base", 4)).alias("baseline_runtime_ms"),
        F.when(F.col("is_perf"), round_to("_mut", 4)).alias("mutated_runtime_ms"),
        F.col("variant").alias("mutated_kernel_code"),
    )


def mutation_rows(attempts: DataFrame) -> DataFrame:
    """J3 rows: the applicable attempts (14 fields)."""
    return attempts.where(F.col("applicable")).drop("applicable")


def mutation_summary(attempts: DataFrame) -> DataFrame:
    """Attempted / applicable / validated per device and mutation, with rates (4 digits)."""
    s = attempts.groupBy("gpu", "compute_cap", "mutation_type").agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("applicable")).alias("applicable"),
        F.count_if(F.col("applicable") & F.col("validated")).alias("validated"))
    return s.select("gpu", "compute_cap", "mutation_type",
                    F.col("attempted").cast("bigint").alias("attempted"),
                    F.col("applicable").cast("bigint").alias("applicable"),
                    F.col("validated").cast("bigint").alias("validated"),
                    round_to(F.try_divide(F.col("validated").cast("double"), F.nullif(F.col("applicable"), F.lit(0))), 4)
                    .alias("validation_rate"),
                    round_to(F.try_divide(F.col("applicable").cast("double"), F.nullif(F.col("attempted"), F.lit(0))), 4)
                    .alias("applicability_rate"))
