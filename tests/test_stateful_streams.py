"""Streams with keyed state: equal to the batch operators, restarted from a checkpoint, closed by timeouts."""

import random

import pytest
from pyspark.sql import functions as F

from gauntlet.operators import progress as PG
from gauntlet.session import scratch_dir
from gauntlet.streaming import stateful as S

EVENTS = "run_id string, event_id long, ts_us long, failed boolean"
ATTEMPTS = "run_id string, item long, attempt int, at_ms long, kind string, message string, status_code int"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    S.use_rocksdb(spark)


class Feed:
    """Folders that a test adds between runs of one query, which goes on from its checkpoint each time."""

    def __init__(self, spark, schema, transform):
        self.spark, self.schema, self.transform = spark, schema, transform
        self.landing, self.sink, self.checkpoint = (scratch_dir(spark, f"t-{x}") for x in ("in", "out", "ckpt"))
        self.added = 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.landing}/{self.added:03d}")
        self.added += 1

    def run(self):
        """A fresh query over what is there, then all rows written by this and earlier ones."""
        schema = self.spark.createDataFrame([], self.schema).schema
        stream = self.transform(S.source_of(self.spark, self.landing, schema))
        S.to_epochs(stream, self.sink, self.checkpoint).awaitTermination()
        return sorted((tuple(r) for r in S.read_epochs(self.spark, self.sink, stream.schema).collect()), key=str)


def py_progress(rows, steps):
    out, counts = [], {}
    for run, event, _, failed in rows:
        done, failures = counts.get(run, (0, 0))
        counts[run] = done, failures = done + 1, failures + bool(failed)
        out += [(run, event, step, done, failures) for step in steps if done % step == 0]
    return sorted(out, key=str)


def test_progress_goes_on_after_a_restart(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b"]), i, i * 1000, rng.choice([True, False, None])) for i in range(230)]
    feed = Feed(spark, EVENTS, lambda s: S.progress_per_run(s, (10, 20, 5)))
    feed.add(rows[:70])
    assert feed.run() == py_progress(rows[:70], (10, 20, 5))
    for part in (rows[70:110], rows[110:]):
        shuffled = list(part)
        rng.shuffle(shuffled)                     # any order within a micro-batch
        feed.add(shuffled)
    assert feed.run() == py_progress(rows, (10, 20, 5))


def ledger_rows(spark, feed):
    return {r[1]: r for r in feed.run()}


def test_ledger_closes_by_attempt_and_by_timeout(spark):
    minute = 60_000
    at = lambda m: 1_700_000_000_000 + m * minute
    feed = Feed(spark, ATTEMPTS, S.live_ledger)
    feed.add([("r", 1, 0, at(0), "ok", None, None),
              ("r", 2, 0, at(0), "empty", "API returned no choices", None),
              ("r", 3, 1, at(1), "ok", None, None),                       # comes before its first attempt
              ("r", 4, 0, at(1), "status", "No such model", 404),
              ("r", 5, 0, at(1), "status", "Service unavailable", 503)])
    got = ledger_rows(spark, feed)
    assert set(got) == {1, 4}
    assert got[1][2:4] == ("success", 1) and got[4][2:4] == ("failed", 1) and got[4][-1] == "attempt"
    feed.add([("r", 3, 0, at(2), "status", "busy", 529), ("r", 2, 1, at(2), "empty", "API returned no choices", None),
              ("r", 1, 1, at(2), "ok", None, None),                       # after it closed
              ("r", 2, 2, at(2), "ok", None, None)])                      # beyond the last attempt
    got = ledger_rows(spark, feed)
    assert set(got) == {1, 2, 3, 4}
    assert got[3][2:6] == ("success", 2, 0, 4.0)
    assert got[2][2:6] == ("failed", 2, 1, 12.0) and got[2][6].startswith("generation failed after 2 retries: ")
    assert got[1][3] == 1                                                 # still the first outcome
    feed.add([("r", 9, 0, at(60), "empty", "x", None)])
    feed.add([("r", 10, 0, at(61), "empty", "x", None)])
    got = ledger_rows(spark, feed)
    assert got[5][-1] == "timeout" and got[5][2:4] == ("failed", 1)
    assert not {9, 10} & set(got)


def test_ledger_equals_the_batch_operator(spark):
    rng = random.Random(8)
    kinds = [("ok", None, None), ("empty", "API returned no choices", None), ("status", "No such model", 404), ("status", "busy", 503),
             ("rate_limit", "Error code: 429 free-models-per-day", 429), ("rate_limit", "{'X-RateLimit-Reset': '1700000100000'}", 429)]
    rows = [(f"r{item % 3}", item, n, 1_700_000_000_000 + item * 1000 + n * 500, *rng.choice(kinds)) for item in range(120) for n in range(2)]
    feed = Feed(spark, ATTEMPTS, S.live_ledger)
    for k in range(3):
        feed.add(rows[k * 80:(k + 1) * 80])
    batch = PG.retry_outcome(spark.createDataFrame(rows, ATTEMPTS), ["run_id", "item"]).collect()
    assert [r[:-1] for r in feed.run()] == sorted((tuple(r) for r in batch), key=str)


def test_slots_without_a_result_become_null(spark):
    base = 1_700_000_000
    slots = scratch_dir(spark, "t-slots")
    results = scratch_dir(spark, "t-results")
    when = lambda name: F.timestamp_seconds(name).alias(name)
    for k, (opened, found) in enumerate([
            ([(i, base + i) for i in range(6)], [(4, base + 9), (1, base + 20)]),
            ([(50, base + 7200)], [(0, base + 30), (50, base + 7201)]),
            ([(51, base + 7300)], [(99, base + 7300)])]):
        spark.createDataFrame([("r", *x) for x in opened], "run_id string, idx long, opened long").select(
            "run_id", "idx", when("opened")).coalesce(1).write.parquet(f"{slots}/{k}")
        spark.createDataFrame([("r", *x, f"p{x[0]}") for x in found], "run_id string, idx long, finished long, predict string").select(
            "run_id", "idx", when("finished"), "predict").coalesce(1).write.parquet(f"{results}/{k}")
    left, right = (S.source_of(spark, d, spark.read.parquet(f"{d}/0").schema) for d in (slots, results))
    sink = scratch_dir(spark, "t-restored")
    stream = S.live_order_restore(left, right).select("idx", "predict")
    S.to_epochs(stream, sink, scratch_dir(spark, "t-restored-ckpt")).awaitTermination()
    got = {r.idx: r.predict for r in S.read_epochs(spark, sink, stream.schema).collect()}
    assert got == {0: "p0", 1: "p1", 2: None, 3: None, 4: "p4", 5: None, 50: "p50"}


def test_items_of_a_bucket_close_on_their_own_timers(spark):
    minute = 60_000
    at = lambda m: 1_700_000_000_000 + m * minute
    feed = Feed(spark, ATTEMPTS, lambda s: S.live_ledger(s, buckets=1))
    first = [(None if i % 5 == 0 else "r", i, 0, at(i % 20), "empty", f"m{i}", None) for i in range(40)]
    feed.add(first + [("r", 100, 0, at(0), "ok", None, None), ("s", 1, 0, at(0), "status", "No such model", 404)])
    got = {r[:2]: r for r in feed.run()}
    assert set(got) == {("r", 100), ("s", 1)} and got["s", 1][2:4] == ("failed", 1)
    feed.add([("r", 11, 1, at(25), "ok", None, None), (None, 5, 1, at(25), "empty", "busy", None), ("r", 100, 1, at(25), "ok", None, None)])
    got = {r[:2]: r for r in feed.run()}                                  # the watermark is at 15: timers up to 14 are over
    early = {r[:2] for r in first if r[3] + 10 * minute < at(15)}
    assert set(got) == early - {("r", 11), (None, 5)} | {("r", 11), (None, 5), ("r", 100), ("s", 1)}
    assert got["r", 11][2:4] == ("success", 2) and got[None, 5][2:4] == ("failed", 2) and got["r", 100][3:5] == (1, 0)
    assert all(got[k][-1] == "timeout" and got[k][3] == 1 for k in early - {("r", 11), (None, 5)})
    feed.add([("r", 200, 0, at(90), "empty", "x", None)])
    feed.add([("r", 201, 0, at(91), "empty", "x", None)])
    closed = [r[:2] for r in feed.run()]
    assert len(closed) == len(set(closed)) and set(closed) == {r[:2] for r in first} | {("r", 100), ("s", 1)}


def test_ledger_state_has_a_row_for_each_bucket_not_each_item(spark):
    landing, sink, checkpoint = (scratch_dir(spark, f"t-{x}") for x in ("many-in", "many-out", "many-ckpt"))
    rows = spark.range(3000).selectExpr("'r' AS run_id", "id AS item", "0 AS attempt", "1700000000000 + id AS at_ms", "'empty' AS kind",
                                        "'busy' AS message", "CAST(NULL AS INT) AS status_code")
    rows.coalesce(1).write.parquet(f"{landing}/0")
    query = S.to_epochs(S.live_ledger(S.source_of(spark, landing, rows.schema), timeout_ms=60_000_000), sink, checkpoint)
    query.awaitTermination()
    state = max(x.numRowsTotal for p in query.recentProgress for x in p.stateOperators)
    assert 0 < state <= 1024
