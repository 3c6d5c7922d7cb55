"""Driver contract, file round trips, and Spark-vs-DuckDB on a sample of keys at sf0.001."""

import json
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_mod
from sf_paths import SF_SMALL
from gauntlet.plans.catalog import PROMPT_HEADER, QUERIES
from gauntlet.plans.oracle import HEADER_CHARS, ORACLE_SQL
from gauntlet.session import scratch_dir
from gauntlet.sources import files as IO
from gauntlet.sources.tables import BASE_TABLES


def test_entry_and_keys(spark):
    df = entry_mod.entry(spark)
    assert df.count() == 4
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) == set(ORACLE_SQL) and set(QUERIES) <= set(q)
    assert HEADER_CHARS == len(PROMPT_HEADER)


def test_jsonl_keeps_nulls_and_non_ascii(spark):
    root = scratch_dir(spark, "t-jsonl")
    df = spark.createDataFrame([(1, None, "↵ é"), (2, "x", "plain")], "idx int, reason string, preview string")
    IO.write_jsonl(df, root, keep_nulls=True)
    lines = [r.value for r in spark.read.text(root).collect()]
    assert all('"reason":' in ln for ln in lines)
    assert any("↵ é" in ln for ln in lines)
    back = {r.idx: r for r in spark.read.schema(df.schema).json(root).collect()}
    assert back[1].reason is None and back[1].preview == "↵ é"


def test_predictions_reader_fails_fast(spark):
    root = scratch_dir(spark, "t-bad")
    spark.createDataFrame([('{"instruction": "a"}',), ("not json",)], "value string").coalesce(1).write.text(root)
    with pytest.raises(Exception):
        IO.read_predictions(spark, root).collect()


def test_sidecar_missing_folder_is_empty(spark):
    from gauntlet.plans.catalog import SIDECAR_SCHEMA
    assert IO.read_sidecars(spark, scratch_dir(spark, "t-none"), SIDECAR_SCHEMA).count() == 0


def test_task_reader_rejects_unknown_dataset(spark):
    with pytest.raises(ValueError):
        IO.read_task_arrays(spark, scratch_dir(spark, "t-x"), datasets=("other",))


def _canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


SAMPLE = ["extract_code", "classify_kernel_failure", "failure_dataset", "phase_funnel", "retry_outcome",
          "latency_percentiles", "speedup_stats", "job_mutation_report", "progress_running", "src_tasks",
          "job_evaluation_report", "force_block_value", "stream_progress", "stream_classify", "job_generation_report",
          "metric_report", "sidecar_join", "mutation_totals", "low_applicability", "instrument_source", "zip_by_index"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", SAMPLE)
def test_spark_matches_oracle(spark, duck, key):
    sdf = entry_mod.queries()[key](spark, SF_SMALL)
    rel = duck.sql(entry_mod.oracle_sql()[key])
    cols = sorted(sdf.columns)
    assert cols == sorted(rel.columns)
    si = [sdf.columns.index(c) for c in cols]
    di = [rel.columns.index(c) for c in cols]
    s = Counter(tuple(_canon(r[i]) for i in si) for r in sdf.collect())
    d = Counter(tuple(_canon(r[i]) for i in di) for r in rel.fetchall())
    assert s == d, json.dumps([str(list((s - d).elements())[:1]), str(list((d - s).elements())[:1])])[:2000]


def test_corpus_fallback_when_primary_missing(spark):
    root = scratch_dir(spark, "t-corpus")
    df = spark.createDataFrame([("a/k1.py", "x = 1\n"), ("b/k2.py", "y = 2\n")], "name string, text string")
    IO.write_named_files(df, root, "name", "text")
    got = IO.read_corpus_with_fallback(spark, scratch_dir(spark, "t-missing"), root)
    assert sorted((r.kernel_id, r.source) for r in got.collect()) == [("k1.py", "x = 1\n"), ("k2.py", "y = 2\n")]
    with pytest.raises(FileNotFoundError):
        IO.read_corpus_with_fallback(spark, scratch_dir(spark, "t-none1"), scratch_dir(spark, "t-none2"))


def test_summary_document_is_nested_and_keeps_nulls(spark):
    from gauntlet.plans import catalog, jobs
    report = catalog._evaluation_summary(spark, SF_SMALL, with_generation=True)
    docs = {r.run_id: json.loads(r.document) for r in jobs.summary_document(report).collect()}
    assert set(docs) == {"run_0", "run_1", "run_2", "run_3"}
    d = docs["run_3"]
    assert "generation" in d and d["generation"] is None  # no telemetry for run_3, key kept
    assert set(d["phase2_exec_acc"]) == {"passed", "rate", "rate_among_phase1"}
    fa = d["failure_analysis"]
    assert fa["total_failures"] == fa["hardware_failures"] + fa["code_failures"] == sum(fa["by_type"].values())
    assert docs["run_0"]["generation"]["latency_s"]["p50"] is not None


def test_task_file_single_array(spark):
    root = scratch_dir(spark, "t-taskfile")
    items = [{"instruction": "a"}, {"instruction": "b", "input": None}, {"instruction": "c", "input": "x"}]
    spark.createDataFrame([(json.dumps(items),)], "value string").coalesce(1).write.text(root)
    got = sorted(tuple(r) for r in IO.read_task_file(spark, root, "simp").collect())
    assert got == [("simp", 0, "a", None), ("simp", 1, "b", None), ("simp", 2, "c", "x")]
    with pytest.raises(ValueError):
        IO.read_task_file(spark, root, "other")


def test_broken_task_array_fails_and_file_names_are_decoded(spark):
    root = scratch_dir(spark, "t-broken")
    for name, text in (("simp", '[{"instruction": "a"}]'), ("comp", '[{"instruction": "b"')):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/dataset={name}")
    with pytest.raises(Exception, match="broken JSON array"):
        IO.read_task_arrays(spark, root).collect()
    names = scratch_dir(spark, "t-names")
    IO.write_named_files(spark.createDataFrame([("a b+c.py", "x"), ("é%20.py", "y")], "name string, text string"), names, "name", "text")
    assert sorted(r.kernel_id for r in IO.read_corpus(spark, names).collect()) == ["a b+c.py", "é%20.py"]
    with pytest.raises(FileNotFoundError):
        IO.read_corpus(spark, names, glob="*.txt")
