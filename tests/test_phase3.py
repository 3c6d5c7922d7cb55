"""Phase-3 block of the evaluation report: ordered bounded tails, gating by run logs, timings; Python's repr."""

import random

from pyspark.sql import functions as F

from gauntlet.functions.text import python_repr
from gauntlet.operators import efficiency as EF
from gauntlet.plans import jobs

LINES = "run_id string, stream string, n long, line string"


def py_tail(lines, chars):
    """The tail of one run's (stream, n, line) rows, from the assembled text."""
    out = sorted((n, line or "") for s, n, line in lines if s == "stdout")
    err = [line for _, line in sorted((n, line or "") for s, n, line in lines if s == "stderr")
           if "ZeroDivisionError" not in line and "avg" not in line]
    text = "".join(line + "\n" for _, line in out)
    if err:
        text += "\n[stderr]\n" + "\n".join(err)
    return text[-chars:]


def tails(spark, rows, chars):
    df = spark.createDataFrame(rows, LINES)
    return {r.run_id: r.raw_output_tail for r in EF.output_tails(df, ["run_id"], ["n"], chars).collect()}


def test_tails_against_assembled_text(spark):
    rng = random.Random(1)
    rows = []
    for run in range(25):
        for stream in ("stdout", "stderr"):
            for n in range(rng.choice([0, 1, 3, 40])):
                line = rng.choice(["", None, "avg: 1", "ZeroDivisionError: x", "é" * rng.randrange(30), "k: 1.5", "y" * 700])
                rows.append((f"r{run}", stream, n, line))
    for chars in (1, 7, 50, 2000):
        got = tails(spark, rows, chars)
        for run in {r[0] for r in rows}:
            mine = [r[1:] for r in rows if r[0] == run]
            assert got.get(run, "") == py_tail(mine, chars), (run, chars)


def test_only_noise_on_stderr_has_no_section(spark):
    assert tails(spark, [("a", "stdout", 1, "x"), ("a", "stderr", 1, "avg 3")], 100) == {"a": "x\n"}
    assert tails(spark, [("a", "stderr", 1, "boom")], 100) == {"a": "\n[stderr]\nboom"}


def test_hot_run_gathers_only_its_tail(spark):
    """One run holds nearly all lines: they are limited per task and salt before any task sees the run."""
    hot = spark.range(200_000).selectExpr("'hot' AS run_id", "'stdout' AS stream", "id AS n", "concat('line ', id) AS line")
    cold = spark.createDataFrame([("cold", "stdout", 1, "x" * 5000)], LINES)
    out = EF.output_tails(hot.unionByName(cold), ["run_id"], ["n"])
    got = {r.run_id: r.raw_output_tail for r in out.collect()}
    assert got["hot"] == "".join(f"line {i}\n" for i in range(199_000, 200_000))[-2000:]
    assert got["cold"] == "x" * 1999 + "\n"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def evaluation(spark, **more):
    items = spark.createDataFrame([(r, f"k{i}", "code", "test", i % 3) for r in ("ok", "none", "skipped", "quiet") for i in range(6)],
                                  "run_id string, kernel_id string, predict string, test string, passed int")
    probes = spark.createDataFrame([("ok", "k0", 1, 1, "boom")], "run_id string, kernel_id string, seq int, returncode int, stderr string")
    devices = spark.createDataFrame([("ok", "T4", "7.5")], "run_id string, gpu string, compute_cap string")
    lines = spark.createDataFrame(
        [(r, s, n, line) for r in ("ok", "none", "skipped") for s, n, line in (
            ("stdout", 1, "a.py: 2.0"), ("stdout", 2, "speed up: 1.5"), ("stderr", 1, "warn"), ("stderr", 2, "avg n/a"))], LINES)
    alive = F.col("run_id") != "none"
    rows = jobs.evaluation_report(items, probes, devices, alive & (F.col("passed") > 0), alive & (F.col("passed") > 1), lines, ["n"], **more)
    return {r.run_id: r for r in rows.collect()}


def test_phase3_block_is_gated_by_the_run_logs(spark):
    logs = spark.createDataFrame([("ok", 0, 1.0), ("ok", 1, 1.0), ("skipped", 1, 1.0), ("skipped", 0, 61.0), ("none", 0, 1.0)],
                                 "run_id string, returncode int, duration_s double")
    phases = spark.createDataFrame([("ok", "phase1_call_acc", 1.0, 3.26), ("ok", "phase3_efficiency", 5.0, 6.0),
                                    ("ok", "phase3_efficiency", 10.0, 12.5)],
                                   "run_id string, phase string, started_s double, ended_s double")
    got = evaluation(spark, runlogs=logs, phase_log=phases)
    ok = got["ok"]
    assert (ok.phase3_status, ok.n_scripts, ok.n_skipped) == ("measured", 2, 1)
    assert ok.raw_output_tail == "a.py: 2.0\nspeed up: 1.5\n\n[stderr]\nwarn"
    assert (ok.mean_speedup, ok.n_kernels_measured, ok.geomean_speedup) == (1.5, 1, 2.0)
    assert (ok.phase1_call_acc_s, ok.phase2_exec_acc_s, ok.phase3_efficiency_s) == (2.3, None, 2.5)
    assert got["none"].raw_output_tail == got["none"].phase3_status == "skipped (no surviving operators)"
    assert got["skipped"].raw_output_tail == "skipped: all perf scripts failed or timed out (2/2 skipped)"
    assert got["quiet"].raw_output_tail == "skipped: all perf scripts failed or timed out (0/0 skipped)"
    for run in ("none", "skipped", "quiet"):
        assert got[run].mean_speedup is None and got[run].n_kernels_measured == 0 and got[run].geomean_speedup is None


def test_without_run_logs_lines_count_as_measured(spark):
    got = evaluation(spark)
    assert got["none"].phase3_status == "measured" and got["none"].mean_speedup == 1.5
    assert got["quiet"].phase3_status is None and got["quiet"].raw_output_tail == ""


def test_python_repr(spark):
    rng = random.Random(3)
    alphabet = ["'", '"', "\\", "\t", "\n", "\r", "\x00", "\x1b", "\x7f", "\x85", "\xa0", "​", " ", "　", "",
                "a", " ", "é", "漢", "😀", "\U000e0001", "|"]
    texts = ["", "'", '"', "it's", 'say "x"', "it's \"x\"", "plain", "back\\slash"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", python_repr("t").alias("got")).collect():
        assert r.got == repr(r.t)


def test_failed_stub_shows_the_reply_as_python_does(spark):
    replies = [") it's \\ broken", ') "quoted" it\'s\tbroken', ") plain \x07 bell"]
    df = spark.createDataFrame([(t, 1.0, 5, "stop") for t in replies], "reply string, latency_s double, completion_tokens long, finish_reason string")
    got = {r.reply: r.predict for r in jobs.generation_items(df).collect()}
    for t in replies:
        preview = t[:300].replace("\n", "|")
        assert got[t] == f"# generation failed: SyntaxError after fence-strip — raw preview: {preview!r}\n"
