"""Streams with state: progress per run (E1/H1), the retry ledger (E2) and results in any order.

Progress is a ``transformWithStateInPandas`` processor and the ledger, whose items are dealt into buckets, an
``applyInPandasWithState`` function.  Their state lives in the
RocksDB store under the stream's checkpoint and a restarted query goes on
where the last one ended.  State is a few numbers per key: counts for a run,
the attempts seen so far (at most the attempt limit) for an item.

* **Progress** counts completions and failures per run and emits a row at
  every tenth, twentieth or fifth one, whichever steps are asked for.  The
  order within a run is what the result depends on, so a run's rows of one
  micro-batch are sorted in one task; the trigger bounds them, and the state
  kept for a run does not grow.
* **Retry ledger**: an item closes when a terminal attempt comes, when its last
  attempt comes, or when the watermark passes its timer (nothing heard for
  ``timeout_ms`` of event time).  Attempts that come in any order are replayed
  from the first one on; a closed item's later rows are counted as ignored
  only while its state is there, which the same timer drops.
* **Order restore** is a stream-stream left outer join with watermarks on both
  sides; a slot without a result is emitted with null once its patience is over.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gauntlet.functions.classify import MAX_ATTEMPTS
from gauntlet.operators.progress import attempt_verdicts, ledger_outcome
from gauntlet.session import scratch_dir, ship_package
from gauntlet.sources.files import has_files
from gauntlet.sources.tables import fixture
from gauntlet.sources.tables import table as base_table
from gauntlet.streaming.progress import event_time

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PROGRESS_SCHEMA = "run_id string, event_id long, step int, done long, failures long"


class ProgressCounter(StatefulProcessor):
    """Running completions and failures of one run; a row at every completion that a step divides."""

    def __init__(self, steps: tuple[int, ...]):
        self.steps = steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "done long, failures long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, failures = self.counts.get() if self.counts.exists() else (0, 0)
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "event_id"], kind="stable")
        at = done + 1 + pd.RangeIndex(len(batch))
        failed = failures + batch["failed"].fillna(False).astype(bool).cumsum()
        out = pd.DataFrame({"run_id": key[0], "event_id": batch["event_id"].to_numpy(), "done": at, "failures": failed.to_numpy()})
        self.counts.update((int(at[-1]), int(failed.iloc[-1])))
        for step in self.steps:
            yield out[out["done"] % step == 0].assign(step=step)[["run_id", "event_id", "step", "done", "failures"]]

    def close(self) -> None:
        pass


def progress_per_run(events: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """Progress rows of a streaming DataFrame: run_id, event_id, ts_us (order of completion), failed.

    Order holds within a micro-batch and from batch to batch; a source that
    delivers completions late has them counted when they come.  A row without
    a run belongs to the run ``null``, as in the batch form.
    """
    return events.groupBy("run_id").transformWithStateInPandas(
        ProgressCounter(steps), PROGRESS_SCHEMA, "append", "none")


_KEPT = ("attempt", "terminal", "ok", "wait_s", "message", "status_code")
_STATE = "items binary, attempts binary"
_ITEMS = pa.schema([("run_id", pa.string()), ("item", pa.int64()), ("attempts", pa.int32()), ("ignored", pa.int32()), ("closed", pa.bool_()),
                    ("timer", pa.int64())])
_ATTEMPTS = pa.schema([("attempt", pa.int32()), ("terminal", pa.bool_()), ("ok", pa.bool_()), ("wait_s", pa.float64()),
                       ("message", pa.string()), ("status_code", pa.int32())])
BUCKETS = 1024          # items are dealt into so many groups of state, part of a stream's checkpoint


def _packed(rows: list[tuple], schema: pa.Schema) -> bytes:
    columns = zip(*rows) if rows else [()] * len(schema)
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return batch.serialize().to_pybytes()


def _unpacked(data: bytes, schema: pa.Schema) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in pa.ipc.read_record_batch(pa.py_buffer(data), schema).columns))


def retry_ledger(max_attempts: int, timeout_ms: int):
    """Attempts of a bucket's items until they close; ``closed_by`` says what closed an item.

    The state is one row per bucket, which travels with the bucket's rows in
    Arrow batches: its items, each with its own timer, and their attempts.  The
    bucket's timer is the earliest of its items', and an item is dropped when
    its own has passed.
    """

    def replay(known: dict[int, tuple]) -> tuple[list, bool]:
        """Attempts from the first one on without a gap, up to a terminal one; whether the item is complete."""
        steps = []
        for n in range(max_attempts):
            if n not in known:
                return steps, False
            steps.append(known[n])
            if known[n][1]:
                return steps, True
        return steps, True

    def closing(key, steps: list, ignored: int, closed_by: str) -> tuple:
        last = steps[-1]
        return (*key, last[2], last[1], last[4], last[5], len(steps), ignored, sum(s[3] for s in steps), closed_by)

    def expired(key, known: dict[int, tuple], ignored: int, closed: bool) -> Iterator[tuple]:
        if known and not closed:
            steps = [known[n] for n in sorted(known)]
            ends = [n for n, v in enumerate(steps, 1) if v[1]]
            yield closing(key, steps[:ends[0]] if ends else steps, ignored, "timeout")

    def handle(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items: dict[tuple, list] = {}                # (run_id, item): attempts known, ignored, closed, timer
        if state.exists:
            packed_items, packed_attempts = state.get
            attempts = _unpacked(packed_attempts, _ATTEMPTS)
            for run_id, item, n, ignored, closed, timer in _unpacked(packed_items, _ITEMS):
                items[run_id, item] = [{row[0]: row for row in islice(attempts, n)}, ignored, closed, timer]
        watermark, newest, out = state.getCurrentWatermarkMs(), {}, []
        for batch in () if state.hasTimedOut else batches:
            for run_id, item, at, attempt, terminal, ok, wait_s, message, status in zip(
                    *(batch[c].tolist() for c in ("run_id", "item", "at_ms", *_KEPT))):
                key = run_id if run_id == run_id else None, item
                own = items.setdefault(key, [{}, 0, False, 0])
                newest[key] = max(at, newest.get(key, at))
                if own[2] or attempt >= max_attempts or attempt in own[0]:
                    own[1] += 1
                else:
                    # pandas may hold a null as NaN
                    own[0][attempt] = (attempt, bool(terminal), bool(ok), float(wait_s), message if message == message else None,
                                       int(status) if status is not None and status == status else None)
        for key, at in newest.items():
            own = items[key]
            own[3] = at + timeout_ms
            if not own[2]:
                steps, own[2] = replay(own[0])
                if own[2]:
                    out.append(closing(key, steps, own[1], "attempt"))
        for key in [key for key, own in items.items() if own[3] < watermark]:    # a late row's timer has passed already
            out += expired(key, *items.pop(key)[:3])
        if items:
            state.update((_packed([(*key, len(known), *rest) for key, (known, *rest) in items.items()], _ITEMS),
                          _packed([row for known, *_ in items.values() for row in known.values()], _ATTEMPTS)))
            state.setTimeoutTimestamp(min(own[3] for own in items.values()))
        elif state.exists:
            state.remove()
        if out:
            columns = dict(zip((c.split()[0] for c in _CLOSED.split(", ")), zip(*out)))
            yield pd.DataFrame(columns | {"status_code": pd.array(columns["status_code"], "Int32")})

    return handle


_CLOSED = ("run_id string, item long, ok boolean, terminal boolean, message string, status_code int, attempts_used int, "
           "attempts_ignored int, total_wait_s double, closed_by string")


def live_ledger(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, timeout_ms: int = 600_000,
                lateness: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Closed items of a streaming ledger: run_id, item, attempt, kind, message, status_code, at_ms.

    The verdict on a single attempt (terminal, wait, message) is the batch
    operator's Column expression; the state only replays them in order.  A
    stream keeps the number of ``buckets`` it was started with; take more where
    very many items are open at a time, as a bucket's state is read and written whole.
    """
    judged = attempts.where(F.col("item").isNotNull() & F.col("attempt").isNotNull() & F.col("at_ms").isNotNull())
    judged = attempt_verdicts(judged).select(
        "run_id", F.col("item").cast("long"), F.col("attempt").cast("int"), F.col("at_ms").cast("long"), "terminal", "ok", "wait_s",
        "message", F.col("status_code").cast("int"), F.timestamp_millis("at_ms").alias("at"))
    judged = judged.withWatermark("at", lateness).withColumn("bucket", F.pmod(F.xxhash64("run_id", "item"), F.lit(buckets)).cast("int"))
    closed = judged.groupBy("bucket").applyInPandasWithState(
        retry_ledger(max_attempts, timeout_ms), _CLOSED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return ledger_outcome(closed, ["run_id", "item"], max_attempts, "closed_by")


# ------------------------------------------------------------ joins with state

def live_order_restore(slots: DataFrame, results: DataFrame, lateness: str = "10 minutes", patience: str = "30 minutes") -> DataFrame:
    """C9 on streams: each slot with its result, or null once the watermark has passed its patience.

    ``slots``: run_id, idx, opened (timestamp); ``results``: run_id, idx,
    finished (timestamp) and payload columns; results come in any order.  A
    left outer join of two streams: state holds a slot only until both
    watermarks have passed ``opened`` plus ``patience``.
    """
    left = slots.withWatermark("opened", lateness).alias("s")
    right = results.withColumnsRenamed({"run_id": "_run", "idx": "_idx"}).withWatermark("finished", lateness).alias("r")
    within = F.expr(f"_run = run_id AND _idx = idx AND finished >= opened AND finished <= opened + INTERVAL {patience}")
    return left.join(right, within, "leftOuter").drop("_run", "_idx")


# ------------------------------------------------------------ running and restarting

def to_epochs(stream: DataFrame, sink: str, checkpoint: str, available_now: bool = True):
    """Start a stateful stream into ``sink/epoch=<id>`` folders, each overwritten when its epoch is replayed."""
    spark = stream.sparkSession
    ship_package(spark)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    writer = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def use_rocksdb(spark: SparkSession) -> None:
    """State of these streams needs the RocksDB store; the choice is part of a stream's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_epochs(spark: SparkSession, sink: str, schema) -> DataFrame:
    """All rows that a stream has written so far."""
    if not has_files(spark, sink):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(sink).select(*schema.fieldNames())


def landed(spark: SparkSession, table: DataFrame, label: str, time: str, files: int = 4) -> str:
    """Write a table as ``files`` folders of one time interval each, the oldest first, as a live source would."""
    landing = scratch_dir(spark, f"{label}-in")
    first, last = table.agg(F.min(time).cast("long"), F.max(time).cast("long")).first()
    slot = F.least(F.floor((F.col(time).cast("long") - F.lit(first or 0)) * files / F.lit((last or 0) - (first or 0) + 1)), F.lit(files - 1))
    for k in range(files):
        table.where(F.coalesce(slot, F.lit(0)) == k).coalesce(1).write.parquet(f"{landing}/{k}")
    return landing


def drained(spark: SparkSession, table: DataFrame, transform, label: str, time: str) -> DataFrame:
    """Land a table in the order of ``time``, run ``transform`` over the stream of it, and read the result back."""
    use_rocksdb(spark)
    landing = landed(spark, table, label, time)
    stream = transform(source_of(spark, landing, table.schema))
    sink, checkpoint = scratch_dir(spark, f"{label}-out"), scratch_dir(spark, f"{label}-ckpt")
    to_epochs(stream, sink, checkpoint).awaitTermination()
    return read_epochs(spark, sink, stream.schema)


def source_of(spark: SparkSession, landing: str, schema) -> DataFrame:
    """The landed folders as a stream, one file per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{landing}/*")


# ------------------------------------------------------------ the registered streams

def run_events(events: DataFrame) -> DataFrame:
    """The events table as completions of runs."""
    return events.select(F.concat(F.lit("run_"), (F.col("user_id") % 4).cast("string")).alias("run_id"), "event_id",
                         F.unix_micros(event_time("ts")).alias("ts_us"), (F.col("event_type") == "error").alias("failed"))


def progress_runs(spark: SparkSession, sf_dir: str, steps: tuple[int, ...]) -> DataFrame:
    return drained(spark, run_events(base_table(spark, sf_dir, "events")), lambda s: progress_per_run(s, steps), "progress-runs", "ts_us")


def ledger_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger without some second attempts, whose items only a timeout closes."""
    return fixture(spark, sf_dir, "attempts").where("NOT (item % 9 = 4 AND attempt = 1)")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(spark, ledger_attempts(spark, sf_dir), live_ledger, "ledger", "at_ms").drop("closed_by")


def slots_and_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every item opens a slot with its first attempt; its result comes with its last one, and some never do."""
    a = fixture(spark, sf_dir, "attempts").select("run_id", F.col("item").alias("idx"), "attempt", "kind", "at_ms")
    slots = a.where("attempt = 0").select("run_id", "idx", F.timestamp_millis("at_ms").alias("opened"))
    results = a.where("attempt = 1 AND idx % 7 <> 3").select("run_id", "idx", "kind", F.timestamp_millis(
        F.col("at_ms") + (F.col("idx") % 5) * 60_000).alias("finished"))
    return slots, results


def order_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_rocksdb(spark)
    slots, results = slots_and_results(spark, sf_dir)
    sources = []
    for name, t, time in (("slots", slots, "opened"), ("results", results, "finished")):
        sources.append(source_of(spark, landed(spark, t, f"order-{name}", time), t.schema))
    stream = live_order_restore(*sources).select("run_id", "idx", "kind")
    sink, checkpoint = scratch_dir(spark, "order-out"), scratch_dir(spark, "order-ckpt")
    to_epochs(stream, sink, checkpoint).awaitTermination()
    return read_epochs(spark, sink, stream.schema)
