"""Steps that few splits, few runs or a call per item would hold up are dealt over tasks."""

import os

import pytest
from pyspark.sql import functions as F

from gauntlet.plans import catalog
from gauntlet.session import scratch_dir
from gauntlet.streaming import classify, stateful
from sf_paths import SF_SMALL


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_lines_are_not_shuffled_by_run_for_the_phase_status(spark, no_broadcast):
    plan = catalog.q_job_evaluate_only(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)


def test_the_corpus_of_the_mutations_is_dealt_over_all_tasks(spark):
    assert catalog._corpus(spark, SF_SMALL).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_landed_files_have_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(classify, "ROWS_PER_FILE", 10)
    folders = {}
    monkeypatch.setattr(classify, "scratch_dir", lambda s, label: folders.setdefault(label, scratch_dir(s, label)))
    rows = spark.range(95).coalesce(1).select(F.lit("r").alias("run_id"), F.col("id").alias("item"), F.lit(0).alias("attempt"), F.lit("empty").alias("kind"),
                                  F.lit("API returned no choices").alias("message"), F.lit(None).cast("int").alias("status_code"))
    out = classify.run_stateless(spark, rows, classify.classify_attempt_stream, "run_id string, item bigint, attempt int, reason string", "t-few")
    assert sorted(r.item for r in out.collect()) == list(range(95))
    landing = folders["t-few-in"].split(":")[-1]
    assert sum(name.endswith(".parquet") for name in os.listdir(landing)) == 10


def test_the_live_ledger_gets_its_state_with_the_rows(spark):
    rows = spark.createDataFrame([], "run_id string, item long, attempt int, at_ms long, kind string, message string, status_code int")
    root = scratch_dir(spark, "t-no-rows")
    rows.write.parquet(root)
    stream = stateful.live_ledger(spark.readStream.schema(rows.schema).parquet(root))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "WithState" in plan and "TransformWithState" not in plan
