"""Fixture tables derived from the driver's read-only parquet tables.

Each fixture is one SQL text that runs unchanged on Spark and DuckDB, so the
Spark queries and the DuckDB oracle start from identical inputs; the operator
logic itself is written separately on each side.  The first eight are the
fixtures of FIXTURES.md; ``kernels``, ``runlogs`` and ``devices`` add the
generated modules, phase-3 run logs and the device dimension that the
evaluation job needs.
"""

from __future__ import annotations

FIXTURE_SQL: dict[str, str] = {}

FIXTURE_SQL["tasks"] = """\
SELECT doc_id AS idx, CASE WHEN doc_id % 2 = 0 THEN 'simp' ELSE 'comp' END AS dataset,
  text AS instruction,
  CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lang || ' ' || source END AS input
FROM documents"""

FIXTURE_SQL["replies"] = """\
SELECT doc_id AS idx, 'model_' || (doc_id % 3) AS model,
  CASE WHEN doc_id % 17 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
  CAST(n_chars AS DOUBLE) / 1000 AS latency_s,
  CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars END AS completion_tokens,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 100 + doc_id % 50 END AS prompt_tokens,
  CASE doc_id % 12
    WHEN 0 THEN '```python' || chr(10) || code || chr(10) || '```'
    WHEN 1 THEN '```py' || chr(10) || code || chr(10) || '```'
    WHEN 2 THEN prose || chr(10) || '```' || chr(10) || code || chr(10) || '```' || chr(10) || prose
    WHEN 3 THEN '```python' || chr(10) || 'old = 1' || chr(10) || '```' || chr(10) || prose || chr(10) || '```python' || chr(10) || code || chr(10) || '```'
    WHEN 4 THEN '```python' || chr(10) || code
    WHEN 5 THEN code
    WHEN 6 THEN replace('```python' || chr(10) || code || chr(10) || '```', chr(10), '↵')
    WHEN 7 THEN replace('```python' || chr(10) || code || chr(10) || '```', chr(10), chr(13) || chr(10))
    WHEN 8 THEN '```cpp' || chr(10) || 'int x;' || chr(10) || '```' || chr(10) || 'prose' || chr(10) || '```python' || chr(10) || code || chr(10) || '```'
    WHEN 9 THEN '```python3' || chr(10) || code || chr(10) || '```'
    WHEN 10 THEN ') ' || prose
    ELSE ' ' || chr(10) || chr(9) END AS reply
FROM (SELECT doc_id, n_chars, prose, '# ' || replace(replace(replace(prose, '↵', ' '), chr(13), ' '), chr(10), chr(10) || '# ') || chr(10)
    || 'x' || doc_id || ' = ' || n_chars || chr(10) || 'def f(a):' || chr(10) || '    return a' AS code
  FROM (SELECT doc_id, n_chars, coalesce(text, '') AS prose FROM documents) t) d"""

FIXTURE_SQL["attempts"] = """\
SELECT 'run_' || (item % 4) AS run_id, item, attempt, at_ms, k AS kind_no,
  CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'rate_limit'
    WHEN 4 THEN 'empty' WHEN 5 THEN 'status' WHEN 6 THEN 'status' ELSE 'rate_limit' END AS kind,
  CASE k WHEN 1 THEN 429 WHEN 2 THEN 429 WHEN 3 THEN 429 WHEN 5 THEN 503 WHEN 6 THEN 404 WHEN 7 THEN 429 ELSE NULL END AS status_code,
  CASE k WHEN 1 THEN 'Error code: 429 free-models-per-day'
    WHEN 2 THEN 'Error code: 429 {''X-RateLimit-Reset'': ''' || (at_ms + 30000) || '''}'
    WHEN 3 THEN 'Rate limit exceeded {''X-RateLimit-Reset'': ''' || (at_ms + 400000) || '''}'
    WHEN 4 THEN 'API returned no choices (model at capacity)'
    WHEN 5 THEN 'Service unavailable' WHEN 6 THEN 'No such model'
    WHEN 7 THEN 'Rate limit exceeded {''X-RateLimit-Reset'': ''' || (at_ms - 5000) || '''}'
    ELSE '' END AS message
FROM (SELECT CAST(floor(event_id / 2) AS BIGINT) AS item, CAST(event_id % 2 AS INT) AS attempt,
  1700000000000 + event_id * 1000 AS at_ms, CAST((user_id + event_id * 3) % 8 AS INT) AS k FROM events) e"""

FIXTURE_SQL["probes"] = """\
SELECT 'run_' || (o_custkey % 4) AS run_id, 'k' || o_orderkey || '.py' AS kernel_id, o_orderstatus, seq,
  CASE WHEN o_orderkey % 7 = 0 AND o_orderstatus <> 'F' THEN 0 ELSE 1 END AS returncode,
  repeat('x', CAST(o_orderkey % 5 AS INT) * 600) || chr(10) || CASE CAST((o_orderkey + seq) % 20 AS INT)
    WHEN 0 THEN 'OutOfResources: out of resource: shared memory, Required: 65536'
    WHEN 1 THEN 'out of resource: registers'
    WHEN 2 THEN 'CUDA error: no kernel image is available for execution on the device'
    WHEN 3 THEN 'ValueError: type fp8e4nv not supported in this architecture, fp8'
    WHEN 4 THEN 'torch.OutOfMemoryError: CUDA out of memory'
    WHEN 5 THEN 'an illegal memory access was encountered'
    WHEN 6 THEN 'AttributeError: module ''triton.language'' has no attribute ''pow'''
    WHEN 7 THEN 'triton.compiler.errors.UnsupportedLanguageConstruct: at 3:4'
    WHEN 8 THEN 'triton.compiler.errors.CompilationError: at 9:1'
    WHEN 9 THEN 'AssertionError: only 2D input is supported'
    WHEN 10 THEN 'BLOCK_SIZE exceeds the limit'
    WHEN 11 THEN 'AssertionError: Tensors not equal'
    WHEN 12 THEN 'NameError: name ''tl'' is not defined'
    WHEN 13 THEN 'TimeoutExpired: kernel did not complete within 60s'
    WHEN 14 THEN 'triton.compiler.errors.CompilationError: type bf16 unsupported'
    WHEN 15 THEN 'triton.compiler.errors.CompilationError triton.compiler.errors.UnsupportedLanguageConstruct'
    WHEN 16 THEN 'AssertionError: block must be a power of 2'
    WHEN 17 THEN 'SyntaxError in test: allclose mismatch'
    WHEN 18 THEN 'Feature .bf16 requires .target sm_80 or higher'
    ELSE 'KeyError: 1' END AS stderr
FROM (SELECT *, 1 AS seq FROM orders WHERE o_orderkey % 13 <> 0
  UNION ALL SELECT *, 2 AS seq FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 13 <> 0) o"""

FIXTURE_SQL["speedup_lines"] = """\
SELECT l_orderkey AS run_id, l_linenumber AS line_no,
  CASE WHEN l_linenumber = 7 THEN 'speed up: ' ELSE 'k' || l_partkey || '.py: ' END
  || CAST(CAST(floor(v / 10000) AS BIGINT) AS STRING) || '.' || lpad(CAST(v % 10000 AS STRING), 4, '0') AS line
FROM (SELECT l_orderkey, l_partkey, l_linenumber, CAST(floor(l_extendedprice * 4 / l_quantity) AS BIGINT) AS v FROM lineitem) t"""

FIXTURE_SQL["gold"] = """\
SELECT p_partkey, 'g' || p_partkey || '.py' AS kernel_id,
  CASE CAST(p_partkey % 10 AS INT)
    WHEN 0 THEN 'BLOCK_SIZE = 128' || chr(10)
    WHEN 1 THEN 'kernel[grid](x, BLOCK_M=BLOCK, BLOCK_N=BLOCK_N)' || chr(10)
    WHEN 2 THEN 'def k(x, BLOCK_SIZE: tl.constexpr = 64): pass' || chr(10)
    WHEN 3 THEN 'cfg = triton.Config({''BLOCK_SIZE'': 128, "BLOCK_M": 32})' || chr(10)
    WHEN 4 THEN 'BLOCK_SIZE = min(n, 1024)' || chr(10)
    WHEN 5 THEN 'x = torch.empty(4, dtype=torch.float32)' || chr(10)
    WHEN 6 THEN 'y = a.to(tl.float16) + b.to(tl.bfloat16)' || chr(10)
    WHEN 7 THEN 'BLOCK_M = 16' || chr(10) || 'BLOCK_N = 16' || chr(10) || 'BLOCK_SIZE = 32' || chr(10)
    WHEN 8 THEN 'MY_BLOCK_SIZE = 4' || chr(10) || 'if BLOCK_SIZE == 8: pass' || chr(10)
    ELSE 'def f(:' || chr(10) || 'BLOCK_SIZE = 64' || chr(10) END
  || CASE WHEN p_partkey % 6 = 5 THEN '' ELSE repeat('#', 146) || chr(10)
     || CASE WHEN p_partkey % 4 = 3 THEN 'z = 1' ELSE 'def test_k():' || chr(10) || '    BLOCK_SIZE = 128' END END AS source
FROM part"""

# mutation_outcomes: one branch per (mutation, device) in a UNION ALL, so no cross product is planned.
# A variant that does not apply or does not parse is never run, so only the source shapes that the
# mutation changes have an outcome (see ``gold``); some outcomes that should be there are missing.
_OUTCOME_BRANCH = """SELECT 'g' || p_partkey || '.py' AS kernel_id, '{m}' AS mutation_type, '{gpu}' AS gpu, '{cc}' AS compute_cap,
  CASE WHEN (p_partkey + {pos}) % 3 = 0 THEN 0 ELSE 1 END AS returncode,
  CASE WHEN (p_partkey + {pos}) % 3 = 0 THEN 'MUT_RUNTIME_MS=' || p_size || '.5' ELSE '' END AS stdout,
  CASE CAST((p_partkey + {pos}) % 6 AS INT)
    WHEN 1 THEN 'out of resource: shared memory' WHEN 2 THEN 'fp8e4nv not supported'
    WHEN 4 THEN 'arange size must be a power of 2' WHEN 5 THEN 'out of resource: registers' ELSE '' END AS stderr
FROM part WHERE p_partkey % 10 IN ({shapes}) AND p_partkey % 23 <> 0"""
_MUTATIONS = [("shared_mem_overflow", 0, "0, 1, 2, 3, 7"), ("force_fp8", 1, "5, 6"), ("force_bf16", 2, "5"),
              ("non_pow2_block", 3, "0, 1, 2, 3, 7")]
DEVICES = [("Tesla T4", "7.5"), ("NVIDIA A10", "8.6")]
FIXTURE_SQL["mutation_outcomes"] = "\nUNION ALL\n".join(
    _OUTCOME_BRANCH.format(m=m, pos=pos, gpu=gpu, cc=cc, shapes=shapes) for m, pos, shapes in _MUTATIONS for gpu, cc in DEVICES)

FIXTURE_SQL["timings"] = """\
SELECT 'g' || l_partkey || '.py' AS kernel_id, CASE WHEN l_linenumber % 2 = 1 THEN 'baseline' ELSE 'mutated' END AS side,
  l_extendedprice / 1000 AS sample_ms
FROM lineitem"""

FIXTURE_SQL["kernels"] = """\
SELECT 'run_' || (o_custkey % 4) AS run_id, 'k' || o_orderkey || '.py' AS kernel_id, o_orderkey AS idx, o_orderstatus,
  CASE WHEN o_orderkey % 27 = 0 THEN chr(10) || '# generation failed: Error code: 429 rate limit exceeded' || chr(10)
    WHEN o_orderkey % 9 = 0 THEN '# generation failed: API returned empty content (model at capacity)' || chr(10)
    ELSE 'import triton' || chr(10) || 'def k' || o_orderkey || '(x):' || chr(10) || '    return x * ' || o_custkey || chr(10) END AS predict,
  'def test_k():' || chr(10) || '    assert k' || o_orderkey || '(1) == ' || o_custkey AS test
FROM orders"""

FIXTURE_SQL["runlogs"] = """\
SELECT 'run_' || (o_custkey % 4) AS run_id, 'k' || o_orderkey || '_perf.py' AS script, o_orderkey AS seq,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 5 AS INT) + 1 ELSE 0 END AS returncode,
  o_totalprice / 7500 AS duration_s,
  CASE CAST(o_orderkey % 4 AS INT)
    WHEN 0 THEN ''
    WHEN 1 THEN 'ZeroDivisionError: division by zero' || chr(10) || 'avg: n/a' || chr(10)
    WHEN 2 THEN 'Traceback (most recent call last):' || chr(10) || 'ZeroDivisionError: division by zero' || chr(10) || 'RuntimeError: kernel ' || o_orderkey || ' failed ' || repeat('=', CAST(o_orderkey % 3 AS INT) * 70)
    ELSE 'warning: slow path' || chr(13) || chr(10) || 'avg speed 1.0' || chr(10) || chr(10) || 'done' END AS stderr,
  CASE WHEN o_orderkey % 5 = 0 THEN ''
    ELSE 'k' || o_orderkey || '.py: ' || CAST(o_custkey % 3 AS STRING) || '.' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || chr(10)
      || 'speed up: 1.' || lpad(CAST(o_custkey % 100 AS STRING), 2, '0') || chr(10) END AS stdout,
  CASE WHEN o_custkey % 4 = 3 OR o_orderkey % 2 = 1 THEN 'tmp' ELSE 'perf_results' END AS location
FROM orders WHERE o_orderstatus = 'P'"""

# what the speed-up tool of a run wrote to stderr, as rows (run_2 and run_3: nothing), and the phases' start and end
FIXTURE_SQL["efficiency_stderr"] = """\
SELECT 'run_' || (o_custkey % 4) AS run_id, o_orderkey AS line_no,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'ZeroDivisionError: division by zero' WHEN 1 THEN 'avg: n/a'
    WHEN 2 THEN 'RuntimeError: kernel ' || o_orderkey || ' failed ' || repeat('=', CAST(o_orderkey % 3 AS INT) * 70)
    WHEN 3 THEN '' ELSE 'warning: slow path' END AS line
FROM orders WHERE o_orderstatus = 'P' AND (o_custkey % 4 = 0 OR (o_custkey % 4 = 1 AND o_orderkey % 500 < 8))"""

FIXTURE_SQL["phase_log"] = """\
SELECT 'run_' || (o_custkey % 4) AS run_id,
  CASE o_orderstatus WHEN 'F' THEN 'phase1_call_acc' WHEN 'O' THEN 'phase2_exec_acc' ELSE 'phase3_efficiency' END AS phase,
  min(o_orderkey) / 7 AS started_s, max(o_orderkey) / 7 AS ended_s
FROM orders WHERE o_custkey % 4 <> 2 OR o_orderstatus <> 'P' GROUP BY 1, 2"""

FIXTURE_SQL["devices"] = """\
SELECT run_id, gpu, compute_cap FROM (VALUES ('run_0', 'Tesla T4', '7.5'), ('run_1', 'NVIDIA A10', '8.6'),
  ('run_2', 'NVIDIA L4', '8.9'), ('run_3', 'Tesla T4', '7.5')) AS d(run_id, gpu, compute_cap)"""


# base tables each fixture reads
FIXTURE_TABLES: dict[str, tuple[str, ...]] = {
    "tasks": ("documents",), "replies": ("documents",), "attempts": ("events",),
    "probes": ("orders",), "speedup_lines": ("lineitem",), "gold": ("part",),
    "mutation_outcomes": ("part",), "timings": ("lineitem",), "kernels": ("orders",),
    "runlogs": ("orders",), "efficiency_stderr": ("orders",), "phase_log": ("orders",), "devices": (),
}

