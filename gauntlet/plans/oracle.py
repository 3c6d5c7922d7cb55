"""Independent DuckDB statements, one per query key (the correctness oracle).

Only the fixture inputs are shared with the Spark side (as CTEs); every rule
is written again here in plain SQL.  DuckDB's regex engine has no look-ahead,
so the identifier form of the block rewrite is expressed by consuming the
character that follows and putting it back.  The Python parse check has no
SQL form: the fixture's only unparsable source shape is recognised by its
text (``def f(:``), and the only unparsable reply shape by its number; a
brute-force test checks both against ``ast.parse``.
"""

from __future__ import annotations

from gauntlet.sources.fixtures import FIXTURE_SQL

HEADER_CHARS = 587  # length of the system prompt header (checked in tests)
SEP = "'" + "#" * 146 + "'"
WS = ("chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) "
      "|| chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) "
      "|| chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) "
      "|| chr(8287) || chr(12288)")


def ustrip(x: str) -> str:
    return f"trim({x}, {WS})"


def norm(x: str) -> str:
    return f"replace(replace(replace({x}, '↵', chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


BLOCKS = "regexp_extract_all(s, '(?s)```(?:python|py)?\\s*\\n(.*?)\\n```', 1)"
CAND = ustrip("regexp_replace(regexp_replace(s, '^```(?:python|py)?\\s*\\n?', ''), '(?s)\\n?```.*$', '')")


def code_select(src: str = "reply") -> str:
    """Columns s, blocks, cand, code for a reply column (DuckDB lateral aliases)."""
    return (f"{ustrip(norm(src))} AS s, {BLOCKS} AS blocks, {CAND} AS cand, "
            f"CASE WHEN len(blocks) > 0 THEN {ustrip('blocks[-1]')} || chr(10) "
            f"WHEN cand <> '' THEN cand || chr(10) ELSE s || chr(10) END AS code")


def kernel_case(s: str) -> str:
    c = lambda t: f"contains({s}, '{t}')"
    return f"""CASE
 WHEN {c('out of resource')} AND {c('shared memory')} THEN 'shared_mem_overflow'
 WHEN {c('out of resource')} AND {c('regist')} THEN 'register_overflow'
 WHEN {c('no kernel image is available')} THEN 'arch_unsupported'
 WHEN ({c('not supported')} OR {c('unsupported')}) AND ({c('bf16')} OR {c('fp8')} OR {c('float8')}) THEN 'dtype_unsupported'
 WHEN {c('cuda out of memory')} OR {c('out of memory')} THEN 'oom'
 WHEN {c('illegal memory access')} THEN 'illegal_memory_access'
 WHEN {c("attributeerror: module ''triton.language")} OR {c('did you forget to add @triton.jit')}
   OR {c('_builder argument must be provided')} THEN 'triton_api_misuse'
 WHEN {c('triton.compiler.errors.unsupportedlanguageconstruct')} THEN 'triton_unsupported_construct'
 WHEN {c('triton.compiler.errors.compilationerror')} THEN 'triton_compilation_error'
 WHEN {c('assertionerror')} AND ({c('is supported')} OR {c('not supported')} OR {c('must be')} OR {c('input must be')})
   THEN 'model_abdication'
 WHEN {c('must be a power of 2')} OR (({c('block_size')} OR {c('block size')})
   AND ({c('too large')} OR {c('exceeds')} OR {c('expected a power')})) THEN 'invalid_block_size'
 WHEN {c('allclose')} OR {c('mismatch')} OR {c('incorrect')} OR {c('not equal')} THEN 'numerical_mismatch'
 WHEN {c('syntaxerror')} OR {c('nameerror')} OR {c('importerror')} THEN 'code_error'
 ELSE 'other_runtime' END"""


HW = "('shared_mem_overflow', 'register_overflow', 'arch_unsupported', 'dtype_unsupported', 'oom', 'illegal_memory_access')"


def gen_case(msg: str, status: str = "NULL") -> str:
    s = f"lower(coalesce({msg}, ''))"
    c = lambda t: f"contains({s}, '{t}')"
    return f"""CASE
 WHEN {c('daily free quota')} OR {c('free-models-per-day')} THEN 'quota_exhausted'
 WHEN ({c('rate')} AND {c('limit')}) OR {c('429')} THEN 'rate_limit'
 WHEN {c('syntaxerror')} THEN 'syntax_error'
 WHEN {c('no choices')} OR {c('empty content')} THEN 'empty_response'
 WHEN coalesce({status} IN (400, 401, 403, 404, 500, 502, 503, 529), false) OR {c('503')} OR {c('529')} THEN 'api_error'
 ELSE 'other' END"""


def behavior_case(ft: str, err: str) -> str:
    s = f"lower(coalesce({err}, ''))"
    c = lambda t: f"contains({s}, '{t}')"
    return f"""CASE
 WHEN {ft} = 'shared_mem_overflow' THEN 'fail_compile_shared_mem'
 WHEN {ft} = 'dtype_unsupported' THEN 'fail_dtype_unsupported'
 WHEN {ft} = 'invalid_block_size' THEN 'fail_invalid_block_size'
 WHEN {c('shared memory')} OR {c('sram')} OR {c('out of resource')} OR {c('resource')} THEN 'fail_compile_shared_mem'
 WHEN {c('float8')} OR {c('fp8')} OR {c('e4m3')} OR {c('e5m2')} THEN 'fail_dtype_unsupported'
 WHEN {c('requires .target sm_')} OR {c('requires sm_')} THEN 'fail_dtype_unsupported'
 WHEN {c('power of 2')} OR {c('power-of-2')} THEN 'fail_invalid_block_size'
 ELSE {ft} END"""


def block_steps(src: str, names, value: int, prefix: str) -> tuple[list[str], str, str]:
    """Lateral-alias steps applying the four forms per name; returns (columns, final, count)."""
    cols, counts, cur, i = [], [], src, 0
    for name in names:
        forms = [
            (rf"\b{name}\s*=\s*\d+\b", f"{name}={value}"),
            (rf"\b{name}\s*=\s*([A-Za-z_]\w*)(\s*)([^\s(.\[\w]|$)", rf"{name}={value}\2\3"),
            (rf"(\b{name}\s*:\s*tl\.constexpr\s*=\s*)\d+", rf"\1{value}"),
            (rf"(['\"]{name}['\"]\s*:\s*)\d+", rf"\1{value}"),
        ]
        for pat, rep in forms:
            i += 1
            p, r = pat.replace("'", "''"), rep.replace("'", "''")
            cols.append(f"len(regexp_extract_all({cur}, '{p}')) AS {prefix}n{i}")
            cols.append(f"regexp_replace({cur}, '{p}', '{r}', 'g') AS {prefix}c{i}")
            counts.append(f"{prefix}n{i}")
            cur = f"{prefix}c{i}"
    return cols, cur, " + ".join(counts)


def gold_parts() -> str:
    return (f"strpos(source, {SEP}) AS sep_pos, CASE WHEN sep_pos > 0 THEN substr(source, 1, sep_pos - 1) ELSE source END "
            f"AS kpart, CASE WHEN sep_pos > 0 THEN {SEP} ELSE '' END AS sep, "
            f"CASE WHEN sep_pos > 0 THEN substr(source, sep_pos + 146) ELSE '' END AS tpart")


def block_variant_sql(first, second, prefix) -> tuple[str, str]:
    c1, f1, n1 = block_steps("kpart", *first, prefix + "a")
    c2, f2, n2 = block_steps("kpart", *second, prefix + "b")
    cols = ", ".join(c1 + c2)
    expr = (f"CASE WHEN ({n1}) > 0 THEN {f1} || sep || tpart WHEN ({n2}) > 0 THEN {f2} || sep || tpart END")
    return cols, expr


SM_COLS, SM_EXPR = block_variant_sql((("BLOCK_M", "BLOCK_N"), 256), (("BLOCK_SIZE",), 16384), "sm")
NP_COLS, NP_EXPR = block_variant_sql((("BLOCK_SIZE",), 100), (("BLOCK_M", "BLOCK_N"), 100), "np")
FP8_EXPR = ("nullif(replace(replace(replace(replace(source, 'tl.float32', 'tl.float8e4nv'), 'tl.float16', "
            "'tl.float8e4nv'), 'tl.bfloat16', 'tl.float8e4nv'), 'dtype=torch.float32', 'dtype=torch.float8_e4m3fn'), source)")
BF16_EXPR = "nullif(replace(source, 'dtype=torch.float32', 'dtype=torch.bfloat16'), source)"

GOLD_VARIANTS = f"""gv AS (
  SELECT kernel_id, 'gold/' || kernel_id AS path, source, {gold_parts()}, {SM_COLS}, {SM_EXPR} AS v_sm,
    {NP_COLS}, {NP_EXPR} AS v_np, {FP8_EXPR} AS v_fp8, {BF16_EXPR} AS v_bf16
  FROM gold),
gated0 AS (
  SELECT kernel_id, path, source, 'shared_mem_overflow' AS mutation_type, 0 AS pos, 'fail_compile_shared_mem' AS predicted,
    false AS is_perf, v_sm AS variant FROM gv
  UNION ALL SELECT kernel_id, path, source, 'force_fp8', 1, 'fail_dtype_unsupported', false, v_fp8 FROM gv
  UNION ALL SELECT kernel_id, path, source, 'force_bf16', 2, 'runs_no_bf16_speedup', true, v_bf16 FROM gv
  UNION ALL SELECT kernel_id, path, source, 'non_pow2_block', 3, 'fail_invalid_block_size', false, v_np FROM gv),
gated AS (
  SELECT *, CASE WHEN variant IS NULL THEN 'not applicable'
      WHEN contains(variant, 'def f(:') THEN 'ast.parse failed after mutation' END AS skip_reason
  FROM gated0)"""

TEST_FN = r"\bdef (test_\w+)\s*\("

DEVICES = "devs(gpu, compute_cap) AS (VALUES ('Tesla T4', '7.5'), ('NVIDIA A10', '8.6'))"

MUTATION_ROWS = f"""{DEVICES},
base AS (
  SELECT kernel_id, list_sort(list(sample_ms))[count(*) // 2 + 1] AS upper_ms FROM timings
  WHERE side = 'baseline' GROUP BY kernel_id),
mrows AS (
  SELECT g.kernel_id, g.path AS original_kernel_path, g.mutation_type, d.gpu, d.compute_cap,
    CASE WHEN g.mutation_type = 'force_bf16' AND TRY_CAST(split_part(d.compute_cap, '.', 1) AS INTEGER) < 8
      THEN false ELSE g.is_perf END AS perf,
    CASE WHEN g.mutation_type = 'force_bf16' AND TRY_CAST(split_part(d.compute_cap, '.', 1) AS INTEGER) < 8
      THEN 'fail_dtype_unsupported' ELSE g.predicted END AS predicted_behavior,
    regexp_matches(g.variant, '{TEST_FN}') AS has_test,
    CASE WHEN perf AND NOT has_test THEN -1 ELSE coalesce(o.returncode, -1) END AS rc,
    CASE WHEN perf AND NOT has_test THEN 'no test_* function found for timing' ELSE coalesce(o.stderr, '') END AS err,
    CASE WHEN rc <> 0 THEN {kernel_case('lower(err)')} END AS failure_type,
    CASE WHEN perf AND regexp_matches(g.source, '{TEST_FN}') THEN b.upper_ms END AS base_ms,
    CASE WHEN perf AND rc = 0 THEN TRY_CAST(nullif(regexp_extract(coalesce(o.stdout, ''),
      'MUT_RUNTIME_MS=([0-9.eE+\\-]+)', 1), '') AS DOUBLE) END AS mut_ms,
    {behavior_case('failure_type', 'err')} AS beh,
    CASE WHEN perf THEN (CASE WHEN rc <> 0 THEN beh
        WHEN mut_ms IS NOT NULL AND base_ms IS NOT NULL THEN
          (CASE WHEN mut_ms >= 0.95 * base_ms THEN predicted_behavior ELSE 'runs_faster' END)
        ELSE 'runs_unmeasured' END)
      ELSE (CASE WHEN rc = 0 THEN 'runs_clean' ELSE beh END) END AS actual_behavior,
    actual_behavior = predicted_behavior AS validated,
    coalesce(failure_type IN {HW}, false) OR actual_behavior IN ('fail_compile_shared_mem', 'fail_dtype_unsupported')
      AS is_hardware_failure,
    translate(right(err, 2000), chr(10), ' ') AS stderr_excerpt,
    CASE WHEN perf THEN round(base_ms, 4) END AS baseline_runtime_ms,
    CASE WHEN perf THEN round(mut_ms, 4) END AS mutated_runtime_ms,
    g.variant AS mutated_kernel_code
  FROM gated g CROSS JOIN devs d
  LEFT JOIN mutation_outcomes o ON o.kernel_id = g.kernel_id AND o.mutation_type = g.mutation_type
    AND o.gpu = d.gpu AND o.compute_cap = d.compute_cap
  LEFT JOIN base b ON b.kernel_id = g.kernel_id
  WHERE g.skip_reason IS NULL)"""

MROW_COLS = ("kernel_id, original_kernel_path, mutation_type, gpu, compute_cap, predicted_behavior, actual_behavior, "
             "validated, failure_type, is_hardware_failure, stderr_excerpt, baseline_runtime_ms, mutated_runtime_ms, "
             "mutated_kernel_code")


def sql(names, ctes, body: str) -> str:
    """WITH <fixture CTEs>, <extra CTEs> <body>."""
    parts = [f"{n} AS (\n{FIXTURE_SQL[n]}\n)" for n in names] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def fxs(names, body):
    return sql(names, [], body)


def gold_only(body: str, extra=()) -> str:
    return sql(["gold"], [GOLD_VARIANTS, *extra], body)


def mut(body: str, extra=()) -> str:
    return sql(["gold", "mutation_outcomes", "timings"], [GOLD_VARIANTS, MUTATION_ROWS, *extra], body)


# ---- evaluation-side CTEs ---------------------------------------------------------
LATEST = """latest AS (SELECT run_id, kernel_id, max(seq) AS seq, arg_max(returncode, seq) AS returncode,
  arg_max(stderr, seq) AS stderr FROM probes GROUP BY run_id, kernel_id)"""
F1 = """f1 AS (SELECT k.run_id, k.kernel_id, k.predict FROM kernels k WHERE NOT EXISTS (
  SELECT 1 FROM kernels s WHERE s.o_orderstatus <> 'F' AND s.run_id = k.run_id AND s.kernel_id = k.kernel_id))"""
F2 = """s1 AS (SELECT * FROM kernels WHERE o_orderstatus <> 'F'),
f2 AS (SELECT a.run_id, a.kernel_id, a.predict, a.test FROM s1 a WHERE NOT EXISTS (
  SELECT 1 FROM kernels s WHERE s.o_orderstatus = 'P' AND s.run_id = a.run_id AND s.kernel_id = a.kernel_id))"""
REC1 = f"""r1 AS (SELECT f.run_id, f.kernel_id, 1 AS phase_failed, coalesce(l.returncode, -1) AS returncode,
  coalesce(l.stderr, '') AS err, {kernel_case('lower(err)')} AS failure_type,
  failure_type IN {HW} AS is_hardware_failure, translate(right(err, 2000), chr(10), ' ') AS stderr_excerpt,
  f.predict AS kernel_code FROM f1 f LEFT JOIN latest l USING (run_id, kernel_id))"""
REC2 = f"""r2 AS (SELECT f.run_id, f.kernel_id, 2 AS phase_failed, coalesce(l.returncode, -1) AS returncode,
  CASE WHEN coalesce(l.returncode, -1) = 0 THEN '' ELSE coalesce(l.stderr, '') END AS err,
  CASE WHEN coalesce(l.returncode, -1) = 0 THEN 'numerical_mismatch' ELSE {kernel_case('lower(err)')} END AS failure_type,
  failure_type IN {HW} AS is_hardware_failure, translate(right(err, 2000), chr(10), ' ') AS stderr_excerpt,
  regexp_replace(split_part(f.predict || chr(10) || {SEP} || chr(10) || f.test, {SEP}, 1), '\\n+$', '') AS kernel_code
  FROM f2 f LEFT JOIN latest l USING (run_id, kernel_id))"""
FDS = """fds AS (SELECT r.run_id, r.kernel_id, d.gpu, d.compute_cap, r.phase_failed, r.failure_type, r.is_hardware_failure,
  r.stderr_excerpt, r.kernel_code, r.returncode FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) r
  LEFT JOIN devices d USING (run_id))"""
EVAL = ",\n".join([LATEST, F1, F2, REC1, REC2, FDS])


def ev(body: str, extra=(), ctes=()) -> str:
    return sql(["kernels", "probes", "devices", *extra], [EVAL, *ctes], body)


def rate(num: str, den: str) -> str:
    return f"round(CAST({num} AS DOUBLE) * 100 / nullif({den}, 0), 2)"


FUNNEL = f"""funnel AS (SELECT run_id, CAST(count(*) AS BIGINT) AS total_predictions,
  CAST(count_if(o_orderstatus <> 'F') AS BIGINT) AS phase1_passed,
  coalesce({rate("count_if(o_orderstatus <> 'F')", 'count(*)')}, 0.0) AS phase1_rate,
  CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS phase2_passed,
  coalesce({rate("count_if(o_orderstatus = 'P')", 'count(*)')}, 0.0) AS phase2_rate,
  {rate("count_if(o_orderstatus = 'P')", "count_if(o_orderstatus <> 'F')")} AS phase2_rate_among_phase1
  FROM kernels GROUP BY run_id)"""

LEDGER = f"""att AS (
  SELECT *, kind = 'ok' OR (kind = 'rate_limit' AND contains(coalesce(message, ''), 'free-models-per-day'))
      OR (kind = 'status' AND NOT coalesce(status_code IN (503, 529), false)) AS terminal,
    TRY_CAST(nullif(regexp_extract(message, '''X-RateLimit-Reset'':\\s*''(\\d+)''', 1), '') AS BIGINT) AS tok,
    CAST(tok AS DOUBLE) / 1000 - CAST(at_ms AS DOUBLE) / 1000 AS reset_wait,
    CASE WHEN terminal THEN 0.0
      WHEN kind = 'rate_limit' THEN (CASE WHEN tok IS NOT NULL AND reset_wait > 0 AND reset_wait < 300
        THEN reset_wait + 1.0 ELSE 4.0 * pow(2, attempt) END)
      ELSE 4.0 * pow(2, attempt) END AS wait_s,
    CASE WHEN kind = 'ok' THEN NULL
      WHEN kind = 'rate_limit' AND contains(coalesce(message, ''), 'free-models-per-day')
        THEN 'daily free quota exhausted for this API key: ' || coalesce(message, '')
      ELSE coalesce(message, '') END AS msg
  FROM attempts WHERE attempt < 2),
ledger AS (
  SELECT a0.run_id, a0.item,
    CAST(CASE WHEN a0.terminal OR a1.item IS NULL THEN 1 ELSE 2 END AS INTEGER) AS attempts_used,
    round(CASE WHEN a0.terminal OR a1.item IS NULL THEN a0.wait_s ELSE a0.wait_s + a1.wait_s END, 3) AS total_wait_s,
    CASE WHEN a0.terminal OR a1.item IS NULL THEN a0.kind ELSE a1.kind END AS last_kind,
    CASE WHEN a0.terminal OR a1.item IS NULL THEN a0.terminal ELSE a1.terminal END AS last_terminal,
    CASE WHEN a0.terminal OR a1.item IS NULL THEN a0.msg ELSE a1.msg END AS last_msg,
    CASE WHEN a0.terminal OR a1.item IS NULL THEN a0.status_code ELSE a1.status_code END AS last_status,
    CASE WHEN last_kind = 'ok' THEN 'success' ELSE 'failed' END AS outcome,
    CASE WHEN last_kind = 'ok' THEN NULL WHEN last_terminal THEN last_msg
      ELSE 'generation failed after 2 retries: ' || last_msg END AS final_message,
    CASE WHEN last_kind = 'ok' THEN NULL
      ELSE {gen_case('final_message', 'CASE WHEN last_terminal THEN last_status END')} END AS reason
  FROM att a0 LEFT JOIN att a1 ON a1.run_id = a0.run_id AND a1.item = a0.item AND a1.attempt = 1
  WHERE a0.attempt = 0)"""

SPEEDUP = r"^(\S+):\s+([0-9]*\.?[0-9]+)\s*$"


def lines_of(src: str) -> str:
    return (f"CASE WHEN {src} = '' THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace({src}, "
            f"'(\\r\\n|\\n|\\r)$', ''), '\\r\\n|\\n|\\r') END")


KEPT = (f"list_filter({lines_of('coalesce(stderr, %s)' % repr(''))}, "
        "lambda x: NOT (contains(x, 'ZeroDivisionError') OR contains(x, 'avg')))")
SUMMARY = (f"CASE WHEN len({KEPT}) > 0 THEN stdout || chr(10) || '[stderr]' || chr(10) || array_to_string({KEPT}, chr(10)) "
           "ELSE stdout END")

# the timing harness, line by line
HARNESS = [
    "", "", "def _measure(warm_up=3, runs=10):", "    import time", "", "    import torch", "",
    "    wait = torch.cuda.synchronize if torch.cuda.is_available() else (lambda: None)", "",
    "    def once():", "        wait()", "        begin = time.perf_counter()", "        {fn}()", "        wait()",
    "        return 1000.0 * (time.perf_counter() - begin)", "",
    "    for _ in range(warm_up):", "        {fn}()", "    return sorted(once() for _ in range(runs))[runs // 2]", "", "",
    "if __name__ == \"__main__\":", "    try:", "        print(\"MUT_RUNTIME_MS=%r\" % _measure())",
    "    except Exception as problem:", "        print(\"MUT_RUNTIME_ERR=%r\" % str(problem))", ""]


def _harness_literal() -> str:
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in HARNESS)


METRICS = [
    ("phase1_call_acc.rate", "phase1_rate"), ("phase2_exec_acc.rate", "phase2_rate"),
    ("phase2_exec_acc.rate_among_phase1", "phase2_rate_among_phase1"),
    ("phase3_efficiency.mean_speedup", "mean_speedup"), ("phase3_efficiency.geomean_speedup", "geomean_speedup"),
    ("phase3_efficiency.median_speedup", "median_speedup"),
    ("phase3_efficiency.pct_faster_than_pytorch", "pct_faster_than_pytorch"),
    ("generation.latency_s.p50", "gen_latency_p50"), ("generation.latency_s.p95", "gen_latency_p95"),
    ("generation.tokens.total_completion", "gen_total_completion"), ("generation.failures.by_reason", None),
]
BY_REASON = ("CASE WHEN gen_failures_by_reason = '' THEN '{}' ELSE '{' || list_reduce(list_transform(string_split(gen_failures_by_reason, ','), lambda e: '\"' || split_part(e, '=', 1) "
             "|| '\":' || split_part(e, '=', 2)), lambda a, b: a || ',' || b) || '}' END")

# Blank replies (shape 11) and replies that do not parse (shape 10) fail
def repr_sql(s: str) -> str:
    """Python's repr of a string: quotes chosen by content, unprintable characters as escapes."""
    quote = f"CASE WHEN contains({s}, chr(39)) AND NOT contains({s}, chr(34)) THEN chr(34) ELSE chr(39) END"
    one = (f"CASE WHEN c IN (chr(92), {quote}) THEN chr(92) || c WHEN c = chr(9) THEN '\\t' WHEN c = chr(10) THEN '\\n' "
           "WHEN c = chr(13) THEN '\\r' WHEN c <> ' ' AND regexp_matches(c, '[\\p{C}\\p{Z}]') THEN CASE WHEN unicode(c) < 256 "
           "THEN '\\x' || printf('%02x', unicode(c)) WHEN unicode(c) < 65536 THEN '\\u' || printf('%04x', unicode(c)) "
           "ELSE '\\U' || printf('%08x', unicode(c)) END ELSE c END")
    return f"{quote} || array_to_string(list_transform(string_split({s}, ''), lambda c: {one}), '') || {quote}"


GEN_MESSAGE = ("CASE WHEN blank THEN 'generation failed after 2 retries: API returned empty content (model at capacity)' "
               "WHEN idx % 12 = 10 THEN 'SyntaxError after fence-strip — raw preview: ' || "
               + repr_sql("translate(left(reply, 300), chr(10), '|')") + " END")


def generation_sql(key: str, name: str) -> str:
    """CTEs gitems and gen: J1's items and its report per ``key``."""
    return f"""gitems AS (SELECT *, {key} AS {name}_, {ustrip("coalesce(reply, '')")} = '' AS blank, {GEN_MESSAGE} AS message,
  CASE WHEN message IS NOT NULL THEN {gen_case('message')} END AS reason,
  CASE WHEN NOT blank THEN round(latency_s, 3) END AS lat, CASE WHEN NOT blank THEN nullif(completion_tokens, 0) END AS ctok,
  CASE WHEN NOT blank THEN prompt_tokens END AS ptok, NOT blank AND coalesce(finish_reason, '') = 'length' AS cut FROM replies),
greasons AS (SELECT {name}_, string_agg(reason || '=' || n, ',' ORDER BY reason) AS failures_by_reason FROM (
  SELECT {name}_, reason, count(*) AS n FROM gitems WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY {name}_),
gen AS (SELECT g.{name}_ AS {name}, g.* EXCLUDE ({name}_), r.failures_by_reason FROM (
  SELECT {name}_, CAST(count(*) AS BIGINT) AS n_items, CAST(count(reason) AS BIGINT) AS failures_total,
    {pct_sql('lat', 50)} AS latency_p50, {pct_sql('lat', 95)} AS latency_p95, round(avg(lat), 3) AS latency_mean,
    CAST(coalesce(sum(ptok), 0) AS BIGINT) AS total_prompt, CAST(coalesce(sum(ctok), 0) AS BIGINT) AS total_completion,
    round(avg(ctok), 1) AS mean_completion, CAST(count_if(cut) AS BIGINT) AS truncated_count
  FROM gitems GROUP BY {name}_) g LEFT JOIN greasons r USING ({name}_))"""


RUN_OF_MODEL = "'run_' || split_part(model, '_', 2)"


def pct_sql(col: str, p: int) -> str:
    k = f"greatest(0, least(count({col}) - 1, CAST(round_even(CAST({p} AS DOUBLE) / 100 * (count({col}) - 1), 0) AS BIGINT)))"
    return f"round(list_sort(list({col}) FILTER ({col} IS NOT NULL))[{k} + 1], 3)"


def evaluation_summary(with_generation: bool) -> list[str]:
    gen = (generation_sql(RUN_OF_MODEL, "run_id") if with_generation else
           "gen AS (SELECT NULL::VARCHAR AS run_id, NULL::DOUBLE AS latency_p50, NULL::DOUBLE AS latency_p95, "
           "NULL::BIGINT AS total_completion, NULL::VARCHAR AS failures_by_reason WHERE false)")
    body = f"""{FUNNEL},
counts AS (SELECT run_id, CAST(count_if(starts_with({ustrip('predict')}, '# generation failed')) AS BIGINT) AS generation_failures,
  CAST(count_if(NOT starts_with({ustrip('predict')}, '# generation failed')) AS BIGINT) AS usable_predictions
  FROM kernels GROUP BY run_id),
ordrun AS (SELECT o_orderkey, 'run_' || (o_custkey % 4) AS run_id FROM orders),
perf AS (SELECT run_id, CAST(count(*) AS BIGINT) AS n_scripts, CAST(count_if(run_id = 'run_3' OR returncode IS NULL OR returncode <> 0
    OR coalesce(duration_s > 60, false)) AS BIGINT) AS n_skipped FROM runlogs GROUP BY run_id),
status AS (SELECT f.run_id, coalesce(n_scripts, 0) AS n_scripts, coalesce(n_skipped, 0) AS n_skipped,
    CASE WHEN phase2_passed = 0 THEN 'skipped (no surviving operators)' WHEN coalesce(n_scripts, 0) = coalesce(n_skipped, 0)
    THEN 'skipped: all perf scripts failed or timed out (' || coalesce(n_skipped, 0) || '/' || coalesce(n_scripts, 0) || ' skipped)'
    ELSE 'measured' END AS phase3_status FROM funnel f LEFT JOIN perf USING (run_id)),
lines AS (SELECT o.run_id, l.run_id AS run_order, l.line_no, l.line FROM speedup_lines l JOIN ordrun o ON o.o_orderkey = l.run_id
  JOIN status s ON s.run_id = o.run_id AND phase3_status = 'measured'),
output AS (SELECT run_id, string_agg(line || chr(10), '' ORDER BY run_order, line_no, line) AS stdout FROM lines GROUP BY run_id),
errors AS (SELECT run_id, chr(10) || '[stderr]' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) AS stderr
  FROM efficiency_stderr WHERE NOT contains(line, 'ZeroDivisionError') AND NOT contains(line, 'avg') GROUP BY run_id),
spent AS (SELECT run_id, round(max(ended_s - started_s) FILTER (phase = 'phase1_call_acc'), 1) AS phase1_call_acc_s,
  round(max(ended_s - started_s) FILTER (phase = 'phase2_exec_acc'), 1) AS phase2_exec_acc_s,
  round(max(ended_s - started_s) FILTER (phase = 'phase3_efficiency'), 1) AS phase3_efficiency_s FROM phase_log GROUP BY run_id),
ratios AS (SELECT run_id, CAST(regexp_extract(line, '{SPEEDUP}', 2) AS DOUBLE) AS x FROM lines
  WHERE regexp_matches(line, '{SPEEDUP}')),
rstats AS (SELECT run_id, CAST(count(*) AS BIGINT) AS n_kernels_measured,
  round(exp(avg(CASE WHEN x > 0 THEN ln(x) END)), 4) AS geomean_speedup, round(median(x), 4) AS median_speedup,
  round(min(x), 4) AS min_speedup, round(max(x), 4) AS max_speedup,
  round(CAST(count_if(x > 1.0) AS DOUBLE) * 100 / count(*), 2) AS pct_faster_than_pytorch FROM ratios GROUP BY run_id),
means AS (SELECT run_id, v AS mean_speedup FROM (
  SELECT run_id, run_order, line_no, line, TRY_CAST({ustrip("substr(line, strpos(line, ':') + 1)")} AS DOUBLE) AS v
  FROM lines WHERE starts_with(line, 'speed up:')) WHERE v IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY run_order DESC, line_no DESC, line DESC) = 1),
fa AS (SELECT run_id, CAST(count(*) AS BIGINT) AS total_failures, CAST(count_if(is_hardware_failure) AS BIGINT) AS hardware_failures
  FROM fds GROUP BY run_id),
bytype AS (SELECT run_id, string_agg(failure_type || '=' || n, ',' ORDER BY failure_type) AS failures_by_type FROM (
  SELECT run_id, failure_type, count(*) AS n FROM fds GROUP BY ALL) GROUP BY run_id),
{gen},
summary AS (SELECT f.run_id, f.total_predictions, c.generation_failures, c.usable_predictions, f.phase1_passed, f.phase1_rate,
  f.phase2_passed, f.phase2_rate, f.phase2_rate_among_phase1, m.mean_speedup,
  coalesce(r.n_kernels_measured, 0) AS n_kernels_measured, r.geomean_speedup, r.median_speedup, r.min_speedup,
  r.max_speedup, r.pct_faster_than_pytorch, coalesce(a.total_failures, 0) AS total_failures,
  coalesce(a.hardware_failures, 0) AS hardware_failures,
  CAST(coalesce(a.total_failures, 0) - coalesce(a.hardware_failures, 0) AS BIGINT) AS code_failures,
  coalesce(b.failures_by_type, '') AS failures_by_type, g.latency_p50 AS gen_latency_p50,
  g.latency_p95 AS gen_latency_p95, g.total_completion AS gen_total_completion, CASE WHEN g.run_id IS NOT NULL THEN coalesce(g.failures_by_reason, '') END AS gen_failures_by_reason,
  s.n_scripts, s.n_skipped, s.phase3_status, CASE WHEN s.phase3_status <> 'measured' THEN s.phase3_status
    ELSE right(coalesce(o.stdout, '') || coalesce(e.stderr, ''), 2000) END AS raw_output_tail,
  t.phase1_call_acc_s, t.phase2_exec_acc_s, t.phase3_efficiency_s
  FROM funnel f JOIN status s USING (run_id) LEFT JOIN output o USING (run_id) LEFT JOIN errors e USING (run_id)
  LEFT JOIN spent t USING (run_id) JOIN counts c USING (run_id) LEFT JOIN means m USING (run_id) LEFT JOIN rstats r USING (run_id)
  LEFT JOIN fa a USING (run_id) LEFT JOIN bytype b USING (run_id) LEFT JOIN gen g USING (run_id))
"""
    return [body]


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    code_cols = code_select()

    # ---- A
    q["src_tasks"] = fxs(["tasks"], "SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY idx) - 1 AS BIGINT) "
                                    "AS idx, instruction, input FROM tasks")
    q["src_predictions"] = fxs(["replies"], "SELECT 'task ' || idx AS instruction, CASE WHEN idx % 5 <> 0 THEN reply "
                                            "ELSE '' END AS predict FROM replies")
    q["src_code_corpus"] = fxs(["gold"], "SELECT kernel_id, source FROM gold")
    q["src_corpus_fallback"] = fxs(["gold"], "SELECT kernel_id, source FROM gold")
    q["src_sidecar_optional"] = fxs(["replies"], """SELECT model,
  CAST(CASE WHEN model = 'model_0' THEN count(*) END AS BIGINT) AS n_items,
  CAST(CASE WHEN model = 'model_0' THEN count_if(finish_reason = 'length') END AS BIGINT) AS truncated_count
  FROM replies GROUP BY model""")
    q["sidecar_path"] = fxs(["replies"], """SELECT idx, path,
  regexp_replace(path, '[^/]*$', '') || regexp_replace(regexp_extract(path, '[^/]*$'), '\\.jsonl$', '') || '.gen_meta.json'
    AS meta_path
  FROM (SELECT idx, 'predictions/' || model || '/run_' || idx
    || CASE idx % 3 WHEN 0 THEN '.jsonl' WHEN 1 THEN '.json' ELSE '.jsonl.bak' END AS path FROM replies)""")
    q["src_stdout_lines"] = fxs(["speedup_lines"], "SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY "
                                                   "line_no, line) - 1 AS BIGINT) AS pos, line FROM speedup_lines")
    from gauntlet.plans.catalog import METRICS_REPORTED
    mlist = "[" + ", ".join(f"'{m}'" for m in METRICS_REPORTED) + "]"
    q["src_experiment_config"] = fxs(["tasks", "replies"], f"""SELECT dataset, 'model' AS section,
  CAST(row_number() OVER (PARTITION BY dataset ORDER BY model) - 1 AS BIGINT) AS pos, 'org/' || model AS value
  FROM (SELECT DISTINCT t.dataset, r.model FROM tasks t JOIN replies r USING (idx))
UNION ALL
SELECT dataset, 'metric' AS section, unnest(range(0, {len(METRICS_REPORTED)})) AS pos, unnest({mlist}) AS value
  FROM (SELECT DISTINCT dataset FROM tasks)""")
    q["sink_jsonl_roundtrip"] = fxs(["replies"], f"""SELECT idx, model,
  CASE WHEN {ustrip('reply')} = '' THEN 'empty_response' END AS fail_reason,
  translate(left(reply, 300), chr(10), '|') AS preview, CAST(4 AS BIGINT) AS n_keys FROM replies""")
    q["sink_summary_doc"] = sql(["kernels"], [FUNNEL], """SELECT run_id, total_predictions, phase1_passed, phase1_rate,
  phase2_passed, phase2_rate, phase2_rate_among_phase1, true AS has_generation_key FROM funnel""")
    q["sink_overwrite"] = fxs(["kernels"], """SELECT run_id, CAST(count(*) AS BIGINT) AS n FROM kernels
  WHERE o_orderstatus = 'F' AND (run_id NOT IN ('run_0', 'run_1') OR idx % 2 = 0) GROUP BY run_id""")
    q["run_tag"] = fxs(["tasks"], """SELECT idx, replace(replace('org/model-' || (idx % 3) || ':free', '/', '_'), ':', '_')
  || '_' || dataset || '_limit' || CASE WHEN (idx % 4) * 10 = 0 THEN 'all' ELSE CAST((idx % 4) * 10 AS VARCHAR) END
  || '_' || (1700000000 + idx) AS tag FROM tasks""")

    # ---- B
    q["prompt_messages"] = fxs(["tasks"], f"""SELECT idx, CAST(2 AS BIGINT) AS n_messages, 'system' AS system_role,
  CAST({HEADER_CHARS} AS BIGINT) AS system_chars, 'user' AS user_role,
  CASE WHEN coalesce(input, '') = '' THEN instruction ELSE instruction || chr(10) || chr(10) || input END AS user_content
  FROM tasks""")
    q["limit_head"] = fxs(["tasks"], """SELECT dataset, idx, instruction FROM tasks WHERE dataset = 'simp'
UNION ALL SELECT dataset, idx, instruction FROM (SELECT *, row_number() OVER (ORDER BY idx) AS rn FROM tasks
  WHERE dataset = 'comp') WHERE rn <= 25""")
    q["newline_normalize"] = fxs(["replies"], f"SELECT idx, {norm('reply')} AS text FROM replies")
    q["unicode_strip"] = fxs(["replies"], f"SELECT idx, {ustrip(norm('reply'))} AS text FROM replies")
    q["extract_fenced_last"] = fxs(["replies"], f"SELECT idx, block FROM (SELECT idx, {code_cols}, blocks[-1] AS block FROM replies)")
    q["extract_unclosed"] = fxs(["replies"], f"SELECT idx, cand AS candidate FROM (SELECT idx, {code_cols} FROM replies) "
                                             "WHERE len(blocks) = 0")
    q["ordered_predictions"] = fxs(["replies"], f"""SELECT CAST(row_number() OVER (ORDER BY idx) - 1 AS BIGINT) AS pos,
  'task ' || idx AS instruction, code AS predict FROM (SELECT idx, {code_cols} FROM replies)""")
    q["extract_code"] = fxs(["replies"], f"SELECT idx, code FROM (SELECT idx, {code_cols} FROM replies)")
    q["stub_filter"] = fxs(["kernels"], f"SELECT run_id, kernel_id, starts_with({ustrip('predict')}, '# generation failed') "
                                        "AS is_stub FROM kernels")
    q["truncated_flag"] = fxs(["replies"], "SELECT idx, coalesce(finish_reason, '') = 'length' AS truncated FROM replies")
    q["reply_preview"] = fxs(["replies", "tasks"], """SELECT r.idx, translate(left(r.reply, 300), chr(10), '|') AS preview,
  left(t.instruction, 60) AS instruction_preview FROM replies r JOIN tasks t USING (idx)""")
    q["stderr_excerpt"] = fxs(["probes"], "SELECT run_id, kernel_id, seq, translate(right(stderr, 2000), chr(10), ' ') "
                                          "AS stderr_excerpt FROM probes")
    q["outcome_snippet"] = fxs(["runlogs"], f"SELECT script, {ustrip(chr(108) + 'eft(coalesce(nullif(stderr, ' + repr('') + '), nullif(stdout, ' + repr('') + '), ' + repr('') + '), 120)')} AS snippet FROM runlogs")
    q["stderr_line_filter"] = fxs(["runlogs"], f"""SELECT script, CASE WHEN len({KEPT}) > 0 THEN array_to_string({KEPT}, chr(10)) END
  AS kept, {SUMMARY} AS summary FROM runlogs""")
    q["output_tail"] = fxs(["runlogs"], f"SELECT script, right({SUMMARY}, 2000) AS tail FROM runlogs")
    q["classify_kernel_failure"] = fxs(["probes"], f"SELECT run_id, kernel_id, seq, {kernel_case('lower(stderr)')} AS failure_type FROM probes")
    q["hardware_flag"] = fxs(["probes"], f"SELECT run_id, kernel_id, seq, ({kernel_case('lower(stderr)')}) IN {HW} AS is_hardware_failure FROM probes")
    q["classify_gen_failure"] = fxs(["attempts"], f"SELECT run_id, item, attempt, {gen_case('message', 'status_code')} AS reason FROM attempts")
    q["reset_delay"] = fxs(["attempts"], """SELECT run_id, item, attempt, round(CASE WHEN tok IS NOT NULL AND w > 0 AND w < 300
  THEN w + 1.0 ELSE 4.0 * pow(2, attempt) END, 3) AS delay_s FROM (
  SELECT *, TRY_CAST(nullif(regexp_extract(message, '''X-RateLimit-Reset'':\\s*''(\\d+)''', 1), '') AS BIGINT) AS tok,
  CAST(tok AS DOUBLE) / 1000 - CAST(at_ms AS DOUBLE) / 1000 AS w FROM attempts WHERE kind = 'rate_limit')""")
    q["backoff_delay"] = fxs(["attempts"], "SELECT run_id, item, attempt, 4.0 * pow(2, attempt) AS delay_s FROM attempts")
    q["probe_timeout_label"] = fxs(["runlogs"], """SELECT script,
  CASE WHEN coalesce(duration_s > 60, false) THEN -1 ELSE returncode END AS returncode,
  CASE WHEN coalesce(duration_s > 60, false) THEN 'TimeoutExpired: kernel did not complete within 60s' ELSE stderr END AS stderr
  FROM runlogs""")
    q["perf_run_status"] = fxs(["runlogs"], """SELECT script, status, status <> 'OK' AS skipped FROM (SELECT script,
  CASE WHEN coalesce(duration_s > 60, false) THEN 'TIMEOUT' WHEN returncode IS NULL THEN 'ERROR'
    WHEN returncode = 0 THEN 'OK' ELSE 'exit ' || returncode END AS status FROM runlogs)""")
    q["gold_split"] = fxs(["gold"], f"""SELECT kernel_id, kpart AS kernel_part, CAST(length(sep) AS BIGINT) AS sep_len,
  tpart AS test_part FROM (SELECT kernel_id, {gold_parts()} FROM gold)""")
    q["strip_embedded_test"] = fxs(["gold"], f"SELECT kernel_id, regexp_replace(split_part(source, {SEP}, 1), '\\n+$', '') AS code FROM gold")
    q["assemble_test_module"] = fxs(["gold"], f"""SELECT kernel_id, kpart || chr(10) || {SEP} || chr(10) || tpart AS module
  FROM (SELECT kernel_id, {gold_parts()} FROM gold)""")
    fb_cols, fb_final, fb_count = block_steps("source", ("BLOCK_M", "BLOCK_N"), 256, "f")
    q["force_block_value"] = fxs(["gold"], f"""SELECT kernel_id, code, n_subs FROM (SELECT kernel_id, {', '.join(fb_cols)},
  {fb_final} AS code, CAST({fb_count} AS BIGINT) AS n_subs FROM gold)""")
    q["variant_shared_mem"] = gold_only("SELECT kernel_id, v_sm AS variant FROM gv")
    q["variant_fp8"] = gold_only("SELECT kernel_id, v_fp8 AS variant FROM gv")
    q["variant_bf16"] = gold_only("SELECT kernel_id, v_bf16 AS variant FROM gv")
    q["variant_non_pow2"] = gold_only("SELECT kernel_id, v_np AS variant FROM gv")
    q["failure_to_behavior"] = fxs(["mutation_outcomes"], f"""SELECT kernel_id, mutation_type, gpu, failure_type,
  {behavior_case('failure_type', 'stderr')} AS behavior FROM (
  SELECT *, {kernel_case('lower(coalesce(stderr, ' + repr('') + '))')} AS failure_type FROM mutation_outcomes WHERE returncode <> 0)""")
    q["predict_by_device"] = fxs(["mutation_outcomes"], """SELECT kernel_id, mutation_type, gpu,
  CASE WHEN mutation_type = 'force_bf16' AND TRY_CAST(split_part(compute_cap, '.', 1) AS INTEGER) < 8 THEN 'fail_dtype_unsupported'
    WHEN mutation_type = 'shared_mem_overflow' THEN 'fail_compile_shared_mem' WHEN mutation_type = 'force_fp8'
    THEN 'fail_dtype_unsupported' WHEN mutation_type = 'force_bf16' THEN 'runs_no_bf16_speedup'
    ELSE 'fail_invalid_block_size' END AS predicted_behavior,
  mutation_type = 'force_bf16' AND NOT coalesce(TRY_CAST(split_part(compute_cap, '.', 1) AS INTEGER) < 8, false) AS is_perf
  FROM mutation_outcomes""")
    q["actual_behavior"] = mut("SELECT kernel_id, mutation_type, gpu, actual_behavior FROM mrows")
    q["mutation_validated"] = mut("SELECT kernel_id, mutation_type, gpu, validated, is_hardware_failure FROM mrows")
    q["instrument_source"] = fxs(["gold"], f"""SELECT kernel_id, fn AS test_fn,
  CASE WHEN fn IS NOT NULL THEN source || chr(10) || replace({_harness_literal()}, '{{fn}}', fn) END AS instrumented
  FROM (SELECT kernel_id, source, nullif(regexp_extract(source, '{TEST_FN}', 1), '') AS fn FROM gold)""")
    q["timing_token"] = fxs(["mutation_outcomes"], """SELECT kernel_id, mutation_type, gpu,
  TRY_CAST(nullif(regexp_extract(coalesce(stdout, ''), 'MUT_RUNTIME_MS=([0-9.eE+\\-]+)', 1), '') AS DOUBLE) AS runtime_ms
  FROM mutation_outcomes""")
    q["parse_speedups"] = fxs(["speedup_lines"], f"""SELECT run_id, line_no, regexp_extract(line, '{SPEEDUP}', 1) AS name,
  CAST(regexp_extract(line, '{SPEEDUP}', 2) AS DOUBLE) AS ratio FROM speedup_lines WHERE regexp_matches(line, '{SPEEDUP}')""")
    q["reported_mean_speedup"] = fxs(["speedup_lines"], f"""SELECT run_id, v AS mean_speedup FROM (
  SELECT run_id, line_no, line, TRY_CAST({ustrip("substr(line, strpos(line, ':') + 1)")} AS DOUBLE) AS v FROM speedup_lines
  WHERE starts_with(line, 'speed up:')) WHERE v IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC, line DESC) = 1""")
    q["summary_project"] = fxs(["mutation_outcomes"], """SELECT DISTINCT gpu,
  'compute_cap,gpu,total_kernels_processed,total_mutations_applicable,total_mutations_attempted' AS keys FROM mutation_outcomes""")
    q["variant_skip_reason"] = gold_only("SELECT kernel_id, mutation_type, skip_reason AS reason FROM gated WHERE skip_reason IS NOT NULL")

    # ---- C
    q["phase1_failures"] = ev("SELECT run_id, kernel_id FROM f1")
    q["phase2_failures"] = ev("SELECT run_id, kernel_id FROM f2")
    q["probe_lookup_default"] = ev("""SELECT f.run_id, f.kernel_id, coalesce(l.returncode, -1) AS returncode,
  coalesce(l.stderr, '') AS stderr FROM f1 f LEFT JOIN latest l USING (run_id, kernel_id)""")
    q["zip_by_index"] = fxs(["gold"], f"""SELECT idx, name, code, test FROM (
  SELECT {gold_parts()}, p_partkey AS idx, kernel_id AS name, kpart AS code, tpart AS test FROM gold)
  WHERE idx % 10 <> 9 AND idx % 5 <> 4""")
    q["variant_cross"] = gold_only("""SELECT kernel_id, mutation_type, CAST(pos AS BIGINT) AS pos, predicted, is_perf,
  variant IS NOT NULL AS applicable FROM gated""")
    q["baseline_join"] = mut("SELECT kernel_id, mutation_type, gpu, baseline_runtime_ms FROM mrows WHERE baseline_runtime_ms IS NOT NULL")
    q["device_join"] = ev("SELECT f.run_id, f.kernel_id, d.gpu, d.compute_cap FROM f1 f LEFT JOIN devices d USING (run_id)")
    q["sidecar_join"] = sql(["kernels", "replies"], [generation_sql(RUN_OF_MODEL, "run_id")], """
SELECT k.run_id, g.n_items, g.latency_mean, g.total_completion, g.total_prompt
  FROM (SELECT DISTINCT run_id FROM kernels) k LEFT JOIN gen g USING (run_id)""")
    q["order_restore"] = fxs(["tasks", "replies"], f"""SELECT t.idx, t.instruction, r.code AS predict FROM tasks t LEFT JOIN (
  SELECT idx, {code_cols} FROM replies WHERE idx % 7 <> 3) r USING (idx)""")
    q["phase_survivors"] = fxs(["kernels"], """SELECT run_id, kernel_id, 1 AS phase FROM kernels WHERE o_orderstatus <> 'F'
UNION ALL SELECT run_id, kernel_id, 2 AS phase FROM kernels WHERE o_orderstatus = 'P'""")
    q["phase2_failure_type"] = ev("SELECT run_id, kernel_id, returncode, failure_type, stderr_excerpt FROM r2")

    # ---- D
    q["prediction_counts"] = fxs(["kernels"], f"""SELECT run_id, CAST(count(*) AS BIGINT) AS total_predictions,
  CAST(count_if(starts_with({ustrip('predict')}, '# generation failed')) AS BIGINT) AS generation_failures,
  CAST(count_if(NOT starts_with({ustrip('predict')}, '# generation failed')) AS BIGINT) AS usable_predictions
  FROM kernels GROUP BY run_id""")
    q["phase_funnel"] = sql(["kernels"], [FUNNEL], "SELECT * FROM funnel")
    q["gen_failures_by_reason"] = sql(["attempts"], [LEDGER], """
SELECT run_id, reason, CAST(count(*) AS BIGINT) AS n FROM ledger WHERE reason IS NOT NULL GROUP BY run_id, reason""")
    q["failure_analysis"] = ev("""SELECT run_id, 'total' AS grouping, 'all' AS key, CAST(count(*) AS BIGINT) AS n FROM fds GROUP BY run_id
UNION ALL SELECT run_id, 'split', CASE WHEN is_hardware_failure THEN 'hardware' ELSE 'code' END, CAST(count(*) AS BIGINT)
  FROM fds GROUP BY run_id, is_hardware_failure
UNION ALL SELECT run_id, 'by_type', failure_type, CAST(count(*) AS BIGINT) FROM fds GROUP BY run_id, failure_type""")
    q["conditional_counts"] = ev("""SELECT run_id, phase_failed, CAST(count(*) AS BIGINT) AS n_failures,
  CAST(count_if(is_hardware_failure) AS BIGINT) AS n_hardware, CAST(count_if(returncode <> 0) AS BIGINT) AS n_probe_nonzero
  FROM fds GROUP BY run_id, phase_failed""")
    q["latency_percentiles"] = fxs(["replies"], f"""SELECT model, CAST(count(latency_s) AS BIGINT) AS n,
  {pct_sql('latency_s', 50)} AS p50, {pct_sql('latency_s', 95)} AS p95 FROM replies GROUP BY model""")
    q["generation_telemetry"] = fxs(["replies"], """SELECT model, CAST(count(*) AS BIGINT) AS n_items,
  round(avg(round(latency_s, 3)), 3) AS latency_mean,
  CAST(coalesce(sum(nullif(completion_tokens, 0)), 0) AS BIGINT) AS total_completion,
  round(avg(nullif(completion_tokens, 0)), 1) AS mean_completion,
  CAST(count_if(coalesce(finish_reason, '') = 'length') AS BIGINT) AS truncated_count FROM replies GROUP BY model""")
    q["speedup_stats"] = fxs(["speedup_lines"], f"""SELECT run_id, CAST(count(*) AS BIGINT) AS n_kernels_measured,
  round(exp(avg(CASE WHEN x > 0 THEN ln(x) END)), 4) AS geomean_speedup, round(median(x), 4) AS median_speedup,
  round(min(x), 4) AS min_speedup, round(max(x), 4) AS max_speedup,
  round(CAST(count_if(x > 1.0) AS DOUBLE) * 100 / count(*), 2) AS pct_faster_than_pytorch,
  CAST(count_if(x <= 0) AS BIGINT) AS n_nonpositive
  FROM (SELECT run_id, CAST(regexp_extract(line, '{SPEEDUP}', 2) AS DOUBLE) AS x FROM speedup_lines
    WHERE regexp_matches(line, '{SPEEDUP}')) GROUP BY run_id""")
    q["upper_median_runtime"] = fxs(["timings"], """SELECT kernel_id, side, CAST(count(*) AS BIGINT) AS n,
  list_sort(list(sample_ms))[count(*) // 2 + 1] AS upper_median FROM timings GROUP BY kernel_id, side""")
    summ = """msum AS (SELECT p.gpu, p.compute_cap, p.mutation_type, t.attempted, t.applicable,
  CAST(coalesce(v.validated, 0) AS BIGINT) AS validated,
  round(CAST(v.validated AS DOUBLE) / nullif(t.applicable, 0), 4) AS validation_rate,
  round(CAST(t.applicable AS DOUBLE) / nullif(t.attempted, 0), 4) AS applicability_rate
  FROM (SELECT DISTINCT devs.gpu, devs.compute_cap, gated.mutation_type FROM gated CROSS JOIN devs) p
  JOIN (SELECT mutation_type, CAST(count(*) AS BIGINT) AS attempted, CAST(count_if(skip_reason IS NULL) AS BIGINT) AS applicable
    FROM gated GROUP BY mutation_type) t USING (mutation_type)
  LEFT JOIN (SELECT gpu, compute_cap, mutation_type, count_if(validated) AS validated FROM mrows GROUP BY ALL) v
    USING (gpu, compute_cap, mutation_type))"""
    q["mutation_summary"] = mut("SELECT * FROM msum", [summ])
    samples = """samples AS (SELECT mutation_type, string_agg(skip_reason, ' | ' ORDER BY kernel_id) AS sample_reasons FROM (
  SELECT mutation_type, kernel_id, skip_reason, row_number() OVER (PARTITION BY mutation_type ORDER BY kernel_id) AS rn
  FROM gated WHERE skip_reason IS NOT NULL) WHERE rn <= 3 GROUP BY mutation_type)"""
    q["low_applicability"] = mut("""SELECT gpu, compute_cap, mutation_type, applicable, attempted, applicability_rate, sample_reasons
FROM msum LEFT JOIN samples USING (mutation_type) WHERE applicability_rate < 0.5""", [summ, samples])
    q["perf_completion"] = fxs(["kernels", "runlogs"], """SELECT k.run_id, CAST(coalesce(r.n, 0) AS BIGINT) AS n_scripts,
  CAST(coalesce(r.sk, 0) AS BIGINT) AS n_skipped, CAST(coalesce(r.n, 0) - coalesce(r.sk, 0) AS BIGINT) AS n_completed,
  CASE WHEN k.surv = 0 THEN 'skipped (no surviving operators)'
    WHEN coalesce(r.n, 0) - coalesce(r.sk, 0) = 0 THEN 'skipped: all perf scripts failed or timed out ('
      || coalesce(r.sk, 0) || '/' || coalesce(r.n, 0) || ' skipped)'
    ELSE 'measured' END AS status
  FROM (SELECT run_id, count_if(o_orderstatus = 'P') AS surv FROM kernels GROUP BY run_id) k
  LEFT JOIN (SELECT run_id, count(*) AS n, count_if(coalesce(duration_s > 60, false) OR returncode IS NULL OR returncode <> 0) AS sk
    FROM runlogs GROUP BY run_id) r USING (run_id)""")
    q["mutation_totals"] = sql(["gold"], [GOLD_VARIANTS, DEVICES], """SELECT gpu, compute_cap,
  CAST(count(DISTINCT kernel_id) AS BIGINT) AS total_kernels_processed,
  CAST(count(*) AS BIGINT) AS total_mutations_attempted, CAST(count_if(skip_reason IS NULL) AS BIGINT) AS total_mutations_applicable
  FROM gated CROSS JOIN devs GROUP BY gpu, compute_cap""")
    q["histogram_map"] = ev("""SELECT run_id, string_agg(failure_type || '=' || n, ',' ORDER BY failure_type) AS by_type FROM (
  SELECT run_id, failure_type, count(*) AS n FROM fds GROUP BY ALL) GROUP BY run_id""")
    unp = "\nUNION ALL ".join(
        f"SELECT run_id, '{m}' AS metric, {('CAST(' + c + ' AS DOUBLE)') if c else 'CAST(NULL AS DOUBLE)'} AS value, {BY_REASON if not c else 'CAST(NULL AS VARCHAR)'} AS detail FROM summary"
        for m, c in METRICS)
    q["metric_report"] = ev(unp, ("speedup_lines", "replies", "runlogs", "efficiency_stderr", "phase_log"), evaluation_summary(True))

    # ---- E / F / G
    q["progress_running"] = """SELECT run_id, event_id, done, failures FROM (
  SELECT 'run_' || (user_id % 4) AS run_id, event_id,
    CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS BIGINT) AS done,
    CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS failures,
    count(*) OVER (PARTITION BY user_id % 4) AS total FROM events)
WHERE done % 10 = 0 OR done = total"""
    steps = "(SELECT unnest([10, 20, 5])::INT AS step)"
    q["stream_run_progress"] = f"""SELECT run_id, event_id, step, done, failures FROM (
  SELECT 'run_' || (user_id % 4) AS run_id, event_id,
    CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS BIGINT) AS done,
    CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS failures FROM events) JOIN {steps} ON done % step = 0"""
    q["progress_probes"] = fxs(["probes"], """SELECT run_id, kernel_id, seq, done, failures FROM (
  SELECT run_id, kernel_id, seq, CAST(row_number() OVER w AS BIGINT) AS done,
    CAST(sum(CASE WHEN coalesce(returncode, -1) <> 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failures,
    count(*) OVER (PARTITION BY run_id) AS total
  FROM probes WINDOW w AS (PARTITION BY run_id ORDER BY kernel_id, seq ROWS UNBOUNDED PRECEDING))
WHERE done % 20 = 0 OR done = total""")
    q["progress_kernels"] = mut("""SELECT gpu, kernel_id, done, validated FROM (
  SELECT gpu, kernel_id, CAST(row_number() OVER w AS BIGINT) AS done, CAST(sum(v) OVER w AS BIGINT) AS validated,
    count(*) OVER (PARTITION BY gpu) AS total
  FROM (SELECT d.gpu, g.kernel_id, count_if(m.validated) AS v FROM gold g CROSS JOIN devs d
        LEFT JOIN mrows m ON m.kernel_id = g.kernel_id AND m.gpu = d.gpu GROUP BY ALL)
  WINDOW w AS (PARTITION BY gpu ORDER BY kernel_id ROWS UNBOUNDED PRECEDING))
WHERE done % 5 = 0 OR done = total""")
    # an item is closed by a terminal attempt, by its last one, or 10 minutes before a watermark that lags by 10
    q["stream_ledger"] = ("WITH " + f"""attempts AS (SELECT * FROM (
{FIXTURE_SQL['attempts']}
) WHERE NOT (item % 9 = 4 AND attempt = 1)),
""" + LEDGER.strip() + """
SELECT l.run_id, l.item, outcome, attempts_used, 0::INT AS attempts_ignored, total_wait_s, final_message, reason
FROM ledger l JOIN (SELECT run_id, item, count(*) AS n, max(at_ms) AS last_ms FROM attempts GROUP BY ALL) x
  ON x.run_id = l.run_id AND x.item = l.item
WHERE n = 2 OR outcome = 'success' OR NOT starts_with(final_message, 'generation failed after')
  OR last_ms + 1200000 <= (SELECT max(at_ms) FROM attempts)""")
    q["stream_order_restore"] = fxs(["attempts"], """SELECT s.run_id, s.item AS idx, r.kind
FROM (SELECT * FROM attempts WHERE attempt = 0) s
LEFT JOIN (SELECT * FROM attempts WHERE attempt = 1 AND item % 7 <> 3) r ON r.run_id = s.run_id AND r.item = s.item
WHERE r.item IS NOT NULL OR s.at_ms + 1800000 < (SELECT least(max(at_ms) FILTER (attempt = 0),
  max(at_ms + item % 5 * 60000) FILTER (attempt = 1 AND item % 7 <> 3)) FROM attempts) - 600000""")
    q["retry_outcome"] = sql(["attempts"], [LEDGER], """
SELECT l.run_id, l.item, outcome, attempts_used, CAST(coalesce(x.n, 0) AS INTEGER) AS attempts_ignored, total_wait_s, final_message, reason
FROM ledger l LEFT JOIN (SELECT run_id, item, count(*) AS n FROM attempts WHERE attempt >= 2 GROUP BY ALL) x
  ON x.run_id = l.run_id AND x.item = l.item""")
    q["sample_reasons"] = gold_only("""SELECT mutation_type, kernel_id, skip_reason AS reason, rn FROM (
  SELECT mutation_type, kernel_id, skip_reason, CAST(row_number() OVER (PARTITION BY mutation_type ORDER BY kernel_id) AS BIGINT) AS rn
  FROM gated WHERE skip_reason IS NOT NULL) WHERE rn <= 3""")
    q["last_write_wins"] = sql(["probes"], [LATEST], "SELECT * FROM latest")
    q["sorted_listing"] = fxs(["kernels"], """SELECT run_id, kernel_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY kernel_id) AS BIGINT)
  AS pos FROM kernels WHERE o_orderstatus <> 'F'""")
    q["listing_top10"] = fxs(["kernels"], """SELECT run_id, kernel_id, rn FROM (SELECT run_id, kernel_id,
  CAST(row_number() OVER (PARTITION BY run_id ORDER BY kernel_id) AS BIGINT) AS rn FROM kernels WHERE o_orderstatus <> 'F')
  WHERE rn <= 10""")
    q["names_except"] = fxs(["probes", "kernels"], """SELECT p.run_id, p.kernel_id, p.seq FROM probes p WHERE NOT EXISTS (
  SELECT 1 FROM kernels s WHERE s.o_orderstatus <> 'F' AND s.run_id = p.run_id AND s.kernel_id = p.kernel_id)""")
    q["failure_dataset"] = ev("""SELECT run_id, kernel_id, gpu, compute_cap, phase_failed, failure_type, is_hardware_failure,
  stderr_excerpt, kernel_code FROM fds""")
    q["fallback_union"] = fxs(["runlogs"], """SELECT run_id, script, location FROM runlogs WHERE location = 'perf_results'
UNION ALL SELECT run_id, script, location FROM runlogs r WHERE location = 'tmp' AND NOT EXISTS (
  SELECT 1 FROM runlogs p WHERE p.location = 'perf_results' AND p.run_id = r.run_id)""")

    # ---- H
    q["stream_progress"] = """SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS n,
  CAST(count_if(event_type = 'error') AS BIGINT) AS failures FROM events
  WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1"""
    q["stream_classify"] = fxs(["probes"], f"""SELECT run_id, kernel_id, seq, failure_type, failure_type IN {HW} AS is_hardware_failure
  FROM (SELECT *, {kernel_case('lower(stderr)')} AS failure_type FROM probes WHERE coalesce(returncode, -1) <> 0)""")
    q["stream_attempts"] = fxs(["attempts"], f"""SELECT run_id, item, attempt, {gen_case('message', 'status_code')} AS reason
  FROM attempts WHERE kind <> 'ok'""")

    # ---- I / J
    q["variant_registry"] = gold_only("""SELECT mutation_type, CAST(pos AS BIGINT) AS pos, predicted, is_perf,
  CAST(count_if(variant IS NOT NULL) AS BIGINT) AS n_applicable, CAST(count_if(skip_reason IS NULL) AS BIGINT) AS n_kept
  FROM gated GROUP BY ALL""")
    q["job_generation_report"] = sql(["replies"], [generation_sql("model", "model")], """
SELECT model, n_items, failures_total, failures_by_reason, latency_p50, latency_p95, latency_mean, total_prompt,
  total_completion, mean_completion, truncated_count FROM gen""")
    q["job_mutation_report"] = mut(f"SELECT {MROW_COLS} FROM mrows")
    cols = ("run_id, total_predictions, generation_failures, usable_predictions, phase1_passed, phase1_rate, phase2_passed, "
            "phase2_rate, phase2_rate_among_phase1, mean_speedup, n_kernels_measured, geomean_speedup, median_speedup, "
            "min_speedup, max_speedup, pct_faster_than_pytorch, total_failures, hardware_failures, code_failures, "
            "failures_by_type, gen_latency_p50, gen_latency_p95, gen_total_completion, gen_failures_by_reason, n_scripts, n_skipped, "
            "phase3_status, raw_output_tail, phase1_call_acc_s, phase2_exec_acc_s, phase3_efficiency_s")
    q["job_evaluation_report"] = ev(f"SELECT {cols} FROM summary", ("speedup_lines", "replies", "runlogs", "efficiency_stderr", "phase_log"), evaluation_summary(True))
    q["job_evaluate_only"] = ev(f"SELECT {cols} FROM summary", ("speedup_lines", "replies", "runlogs", "efficiency_stderr", "phase_log"), evaluation_summary(False))
    return q


ORACLE_SQL = build()
