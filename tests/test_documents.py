"""Report documents: labels with any character, metric paths on variants, limits and sidecar files of the jobs."""

import json

import pytest
from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from gauntlet.operators import documents as D
from gauntlet.operators import stats as ST
from gauntlet.plans import catalog, jobs
from gauntlet.sources.tables import fixture

LABELS = ["a,b", "k=v", "a\\", "\\,=", "x.y['z']", 'say "it\'s"?', "", "é\nü", "plain"]


def test_flat_histograms_come_back_whatever_the_labels(spark):
    rows = [("r", label) for i, label in enumerate(LABELS) for _ in range(i + 1)]
    df = spark.createDataFrame(rows, "run string, label string")
    h = ST.histogram_text(df, ["run"], "label", "h")
    (r,) = h.select("h", "h_text", ST.text_map(F.col("h_text")).alias("back")).collect()
    assert r.back == r.h == {label: i + 1 for i, label in enumerate(LABELS)}
    plain = spark.createDataFrame([("b=2,c=11",), ("",), (None,)], "t string").select(ST.text_map(F.col("t")).alias("m")).collect()
    assert [x.m for x in plain] == [{"b": 2, "c": 11}, {}, {}]


def test_metrics_and_histograms_on_variants(spark):
    hist = {label: i + 1 for i, label in enumerate(LABELS)}
    docs = [("full", json.dumps({"a": {"b": 1.5, "h": hist, "n": None}, "t": "x"})), ("empty", json.dumps({"a": {"h": {}}})),
            ("list", json.dumps({"a": {"h": [1]}})), ("broken", "{"), ("null", None), ("big", json.dumps({"a": {"b": 2**53}}))]
    df = spark.createDataFrame(docs, "run string, document string")
    got = {(r.run, r.metric): (r.value, r.detail) for r in D.metric_values(df, ["run"], ["a.b", "a.h", "a.n", "t"]).collect()}
    assert len(got) == 6 * 4
    assert got["full", "a.b"] == (1.5, None) and got["big", "a.b"] == (float(2**53), None)
    assert got["full", "a.h"][0] is None and json.loads(got["full", "a.h"][1]) == hist
    assert got["empty", "a.h"] == (None, "{}")
    for key in (("full", "a.n"), ("full", "t"), ("list", "a.h"), ("broken", "a.b"), ("null", "a.h"), ("empty", "a.b")):
        assert got[key] == (None, None), key
    entries = D.histogram_entries(df, ["run"], "a.h").collect()
    assert {r.label: r.n for r in entries} == hist and {r.run for r in entries} == {"full"}
    assert D.histogram_entries(df.limit(0), ["run"], "a.h").count() == 0
    assert D.variant_path(["a,b", "k=v", "it's"]) == "$['a,b']['k=v'][\"it's\"]"
    with pytest.raises(ValueError):
        D.variant_path(["what?"])


def test_generation_document_keeps_odd_reasons(spark):
    report = spark.createDataFrame([("m", 3, 0.1, 0.2, 0.15, 3, ST_TEXT, 1, 2, 2.0, 0)], (
        "model string, n_items long, latency_p50 double, latency_p95 double, latency_mean double, failures_total long, "
        "failures_by_reason string, total_prompt long, total_completion long, mean_completion double, truncated_count long"))
    (r,) = jobs.generation_document(report).collect()
    assert json.loads(r.document)["generation"]["failures"]["by_reason"] == {"http 429, again": 1, "code=5": 2}


ST_TEXT = "code\\=5=2,http 429\\, again=1"


def test_jobs_take_a_limit(spark):
    replies = fixture(spark, SF_SMALL, "replies")
    first = jobs.generation_items(replies, limit=7)
    assert sorted(r.idx for r in first.collect()) == sorted(r.idx for r in replies.select("idx").orderBy("idx").limit(7).collect())
    per_model = {r.model: r.n_items for r in jobs.generation_report(replies, ["model"], limit=5).collect()}
    counts = {r.model: r["count"] for r in replies.groupBy("model").count().collect()}
    assert per_model == {m: min(5, n) for m, n in counts.items()}
    corpus = spark.createDataFrame([("b", "p/2", "BLOCK_M = 1"), ("a", "p/3", "BLOCK_M = 1"), ("c", "p/1", "x = 1")],
                                   "kernel_id string, path string, source string")
    outcomes = spark.createDataFrame([], "kernel_id string, mutation_type string, gpu string, compute_cap string, returncode int, "
                                         "stdout string, stderr string")
    timings = spark.createDataFrame([], "kernel_id string, side string, sample_ms double")
    out = jobs.mutation_report(corpus, outcomes, timings, [("T4", "7.5")], limit=2)
    assert out["totals"].collect()[0].total_kernels_processed == 2
    assert {r.kernel_id for r in out["rows"].collect()} == {"b"}       # c is second by path, but nothing applies to it
    assert {r.kernel_id for r in out["skips"].collect()} == {"b", "c"}
    assert jobs.mutation_report(corpus, outcomes, timings, [("T4", "7.5")], limit=0)["totals"].count() == 0


def test_sidecar_files_give_the_same_block(spark):
    own = jobs.generation_sidecar(catalog._run_replies(spark, SF_SMALL), ["run_id"])
    read = jobs.generation_from_documents(catalog._sidecars(spark, SF_SMALL))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, read.collect())) and own.columns == read.columns
