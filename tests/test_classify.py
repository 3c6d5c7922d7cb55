"""Rule cascades: one row per rule plus the ordering conflicts."""

import pytest
from pyspark.sql import functions as F

from gauntlet.functions import classify as C
from gauntlet.operators.progress import retry_outcome

KERNEL_CASES = [
    ("OutOfResources: out of resource: shared memory", "shared_mem_overflow"),
    ("out of resource: registers", "register_overflow"),
    ("no kernel image is available for execution", "arch_unsupported"),
    ("type fp8e4nv not supported", "dtype_unsupported"),
    ("CUDA out of memory", "oom"),
    ("an illegal memory access was encountered", "illegal_memory_access"),
    ("AttributeError: module 'triton.language' has no attribute 'pow'", "triton_api_misuse"),
    ("triton.compiler.errors.UnsupportedLanguageConstruct", "triton_unsupported_construct"),
    ("triton.compiler.errors.CompilationError: at 1:2", "triton_compilation_error"),
    ("AssertionError: input must be 2D", "model_abdication"),
    ("BLOCK_SIZE too large", "invalid_block_size"),
    ("AssertionError: Tensors not equal", "numerical_mismatch"),
    ("NameError: x", "code_error"),
    ("KeyError: 1", "other_runtime"),
    ("", "other_runtime"),
    # ordering conflicts
    ("triton.compiler.errors.CompilationError: bf16 unsupported", "dtype_unsupported"),
    ("triton.compiler.errors.CompilationError triton.compiler.errors.UnsupportedLanguageConstruct",
     "triton_unsupported_construct"),
    ("AssertionError: block must be a power of 2", "model_abdication"),
    ("SyntaxError in test: allclose mismatch", "numerical_mismatch"),
    ("block_size identifier in a traceback", "other_runtime"),
]


def test_kernel_failure_cascade(spark):
    df = spark.createDataFrame(KERNEL_CASES, "stderr string, want string")
    got = df.select("want", C.classify_kernel_failure("stderr").alias("got"),
                    C.is_hardware_failure(C.classify_kernel_failure("stderr")).alias("hw")).collect()
    for r in got:
        assert r.got == r.want
        assert r.hw == (r.want in C.HARDWARE_FAILURE_TYPES)


GEN_CASES = [
    ("daily free quota exhausted", None, "quota_exhausted"),
    ("Error 429", None, "rate_limit"),
    ("please regenerate, limit hit", None, "rate_limit"),  # 'rate' inside 'regenerate'
    ("SyntaxError after fence-strip", None, "syntax_error"),
    ("API returned no choices", None, "empty_response"),
    ("No such model", 404, "api_error"),
    ("upstream 529", None, "api_error"),
    ("boom", None, "other"),
]


def test_generation_cascade(spark):
    df = spark.createDataFrame(GEN_CASES, "m string, code int, want string")
    for r in df.select("want", C.classify_gen_failure("m", "code").alias("got")).collect():
        assert r.got == r.want


@pytest.mark.parametrize("ft,err,want", [
    ("shared_mem_overflow", "", "fail_compile_shared_mem"),
    ("register_overflow", "out of resource: registers", "fail_compile_shared_mem"),
    ("other_runtime", "Feature .bf16 requires .target sm_80", "fail_dtype_unsupported"),
    ("model_abdication", "arange must be a power of 2", "fail_invalid_block_size"),
    ("code_error", "NameError", "code_error"),
])
def test_failure_to_behavior(spark, ft, err, want):
    got = spark.range(1).select(C.failure_to_behavior(F.lit(ft), F.lit(err))).first()[0]
    assert got == want


def test_retry_ledger(spark):
    rows = [
        ("r", 1, 0, 1000, "ok", None, ""),
        ("r", 2, 0, 1000, "rate_limit", 429, "429 free-models-per-day"),
        ("r", 3, 0, 1000, "rate_limit", 429, "{'X-RateLimit-Reset': '31000'}"),
        ("r", 3, 1, 2000, "ok", None, ""),
        ("r", 4, 0, 1000, "status", 503, "Service unavailable"),
        ("r", 4, 1, 2000, "status", 503, "Service unavailable"),
        ("r", 5, 0, 1000, "status", 404, "No such model"),
        ("r", 5, 1, 2000, "ok", None, ""),
    ]
    df = spark.createDataFrame(rows, "run_id string, item int, attempt int, at_ms bigint, kind string, "
                                     "status_code int, message string")
    got = {r.item: r for r in retry_outcome(df, ["run_id", "item"]).collect()}
    assert (got[1].outcome, got[1].attempts_used, got[1].total_wait_s) == ("success", 1, 0.0)
    assert got[2].reason == "quota_exhausted" and got[2].attempts_used == 1
    assert got[2].final_message.startswith("daily free quota exhausted for this API key: ")
    assert (got[3].outcome, got[3].attempts_used, got[3].total_wait_s) == ("success", 2, 31.0)
    assert got[4].final_message == "generation failed after 2 retries: Service unavailable"
    assert got[4].total_wait_s == 12.0 and got[4].reason == "other"
    assert (got[5].outcome, got[5].attempts_used, got[5].reason) == ("failed", 1, "api_error")
