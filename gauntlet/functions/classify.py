"""Ordered rule cascades as Column expressions (``when`` chains over ``contains``).

Each classifier lower-cases its input once; callers that classify wide text
should project ``lower(...)`` into its own column first (see
``operators.funnel.with_failure_type``) so the cascade reads one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _try_cast(c, to: str):
    """Cast that yields null instead of raising under ANSI mode."""
    return (F.col(c) if isinstance(c, str) else c).try_cast(to)


# ---- fixed values (must equal the evaluated pipeline's) -------------------
# kernel-failure cascade: (label, all-of groups), first hit wins; each group is any-of
KERNEL_FAILURE_RULES = [
    ("shared_mem_overflow", [["out of resource"], ["shared memory"]]),
    ("register_overflow", [["out of resource"], ["regist"]]),
    ("arch_unsupported", [["no kernel image is available"]]),
    ("dtype_unsupported", [["not supported", "unsupported"], ["bf16", "fp8", "float8"]]),
    ("oom", [["cuda out of memory", "out of memory"]]),
    ("illegal_memory_access", [["illegal memory access"]]),
    ("triton_api_misuse", [["attributeerror: module 'triton.language",
                            "did you forget to add @triton.jit",
                            "_builder argument must be provided"]]),
    ("triton_unsupported_construct", [["triton.compiler.errors.unsupportedlanguageconstruct"]]),
    ("triton_compilation_error", [["triton.compiler.errors.compilationerror"]]),
    ("model_abdication", [["assertionerror"], ["is supported", "not supported", "must be", "input must be"]]),
    ("invalid_block_size", None),  # special: see kernel_failure_type
    ("numerical_mismatch", [["allclose", "mismatch", "incorrect", "not equal"]]),
    ("code_error", [["syntaxerror", "nameerror", "importerror"]]),
]
KERNEL_FAILURE_FALLBACK = "other_runtime"
HARDWARE_FAILURE_TYPES = ["shared_mem_overflow", "register_overflow", "arch_unsupported",
                          "dtype_unsupported", "oom", "illegal_memory_access"]

GEN_STATUS_API_ERROR = [400, 401, 403, 404, 500, 502, 503, 529]
TIMEOUT_SECONDS = 60
TIMEOUT_MESSAGE = "TimeoutExpired: kernel did not complete within 60s"
RETRY_BASE_DELAY_S = 4.0
MAX_ATTEMPTS = 2
RESET_WINDOW_S = 300
RESET_TOKEN = r"'X-RateLimit-Reset':\s*'(\d+)'"

BEHAVIOR_FAIL_SHARED_MEM = "fail_compile_shared_mem"
BEHAVIOR_FAIL_DTYPE = "fail_dtype_unsupported"
BEHAVIOR_FAIL_BLOCK_SIZE = "fail_invalid_block_size"
BEHAVIOR_RUNS_NO_BF16 = "runs_no_bf16_speedup"
HARDWARE_BEHAVIORS = [BEHAVIOR_FAIL_SHARED_MEM, BEHAVIOR_FAIL_DTYPE]
BF16_MIN_CC_MAJOR = 8
NOT_FASTER_RATIO = 0.95
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(s: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [s.contains(n) for n in needles])


def _all_groups(s: Column, groups) -> Column:
    return reduce(lambda a, b: a & b, [_any(s, g) for g in groups])


def kernel_failure_type(lowered) -> Column:
    """13 ordered rules + fallback over already lower-cased stderr."""
    s = _c(lowered)
    expr = None
    for label, groups in KERNEL_FAILURE_RULES:
        if label == "invalid_block_size":
            cond = s.contains("must be a power of 2") | (
                _any(s, ["block_size", "block size"]) & _any(s, ["too large", "exceeds", "expected a power"]))
        else:
            cond = _all_groups(s, groups)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(KERNEL_FAILURE_FALLBACK))


def classify_kernel_failure(stderr) -> Column:
    return kernel_failure_type(F.lower(F.coalesce(_c(stderr), F.lit(""))))


def is_hardware_failure(failure_type) -> Column:
    """B17."""
    return F.coalesce(_c(failure_type).isin(HARDWARE_FAILURE_TYPES), F.lit(False))


def gen_failure_reason(lowered, status_code=None) -> Column:
    """Generation-failure cascade over a lower-cased message."""
    s = _c(lowered)
    status = F.coalesce(_c(status_code).isin(GEN_STATUS_API_ERROR), F.lit(False)) \
        if status_code is not None else F.lit(False)
    return (
        F.when(_any(s, ["daily free quota", "free-models-per-day"]), "quota_exhausted")
        .when((s.contains("rate") & s.contains("limit")) | s.contains("429"), "rate_limit")
        .when(s.contains("syntaxerror"), "syntax_error")
        .when(_any(s, ["no choices", "empty content"]), "empty_response")
        .when(status | _any(s, ["503", "529"]), "api_error")
        .otherwise("other")
    )


def classify_gen_failure(message, status_code=None) -> Column:
    return gen_failure_reason(F.lower(F.coalesce(_c(message), F.lit(""))), status_code)


def backoff_delay(attempt) -> Column:
    """4.0 * 2^attempt seconds (attempt counts from 0)."""
    return F.lit(RETRY_BASE_DELAY_S) * F.pow(F.lit(2.0), _c(attempt))


def reset_delay(message, now_ms, fallback) -> Column:
    """Wait until the epoch-ms reset token (+1 s) if 0 < wait < 300 s, else fallback."""
    token = _try_cast(F.nullif(F.regexp_extract(_c(message), RESET_TOKEN, 1), F.lit("")), "bigint")
    wait = token / 1000.0 - _c(now_ms) / 1000.0
    return F.when(token.isNotNull() & (wait > 0) & (wait < RESET_WINDOW_S), wait + 1.0).otherwise(_c(fallback))


def truncated_flag(finish_reason) -> Column:
    """B10."""
    return F.coalesce(_c(finish_reason), F.lit("")) == "length"


def probe_timeout(returncode, stderr, duration_s):
    """A probe over the time limit reads as rc -1 with the timeout message."""
    late = F.coalesce(_c(duration_s) > TIMEOUT_SECONDS, F.lit(False))
    return (F.when(late, F.lit(-1)).otherwise(_c(returncode)),
            F.when(late, F.lit(TIMEOUT_MESSAGE)).otherwise(_c(stderr)))


def perf_run_status(returncode, duration_s) -> Column:
    """OK / exit N / TIMEOUT / ERROR (no exit code: the run never started)."""
    return (
        F.when(F.coalesce(_c(duration_s) > TIMEOUT_SECONDS, F.lit(False)), F.lit("TIMEOUT"))
        .when(_c(returncode).isNull(), F.lit("ERROR"))
        .when(_c(returncode) == 0, F.lit("OK"))
        .otherwise(F.concat(F.lit("exit "), _c(returncode).cast("string")))
    )


def failure_to_behavior(failure_type, stderr) -> Column:
    """Direct labels, then keyword rules on lower(stderr), else the label."""
    ft = _c(failure_type)
    s = F.lower(F.coalesce(_c(stderr), F.lit("")))
    return (
        F.when(ft == "shared_mem_overflow", BEHAVIOR_FAIL_SHARED_MEM)
        .when(ft == "dtype_unsupported", BEHAVIOR_FAIL_DTYPE)
        .when(ft == "invalid_block_size", BEHAVIOR_FAIL_BLOCK_SIZE)
        .when(_any(s, ["shared memory", "sram", "out of resource", "resource"]), BEHAVIOR_FAIL_SHARED_MEM)
        .when(_any(s, ["float8", "fp8", "e4m3", "e5m2"]), BEHAVIOR_FAIL_DTYPE)
        .when(_any(s, ["requires .target sm_", "requires sm_"]), BEHAVIOR_FAIL_DTYPE)
        .when(_any(s, ["power of 2", "power-of-2"]), BEHAVIOR_FAIL_BLOCK_SIZE)
        .otherwise(ft)
    )


def cc_major(compute_cap) -> Column:
    return _try_cast(F.split_part(_c(compute_cap), F.lit("."), F.lit(1)), "int")


def predict_by_device(mutation_type, predicted, is_perf, compute_cap):
    """bf16 on a pre-Ampere device is predicted to fail as a dtype limit."""
    pre = (_c(mutation_type) == "force_bf16") & F.coalesce(cc_major(compute_cap) < BF16_MIN_CC_MAJOR, F.lit(False))
    return (F.when(pre, F.lit(BEHAVIOR_FAIL_DTYPE)).otherwise(_c(predicted)),
            F.when(pre, F.lit(False)).otherwise(_c(is_perf)))


def actual_behavior(is_perf, predicted, returncode, behavior_on_failure, mutated_ms, baseline_ms) -> Column:
    """Perf variants compare timings, failure variants read the exit code."""
    rc = _c(returncode)
    perf = (
        F.when(rc != 0, _c(behavior_on_failure))
        .when(_c(mutated_ms).isNotNull() & _c(baseline_ms).isNotNull(),
              F.when(_c(mutated_ms) >= F.lit(NOT_FASTER_RATIO) * _c(baseline_ms), _c(predicted))
              .otherwise(F.lit("runs_faster")))
        .otherwise(F.lit("runs_unmeasured"))
    )
    fail = F.when(rc == 0, F.lit("runs_clean")).otherwise(_c(behavior_on_failure))
    return F.when(_c(is_perf), perf).otherwise(fail)


def mutation_hardware_flag(failure_type, actual) -> Column:
    """Label in the hardware set, or an observed hardware behaviour."""
    return is_hardware_failure(failure_type) | F.coalesce(_c(actual).isin(HARDWARE_BEHAVIORS), F.lit(False))
