"""Phase-3 efficiency output: per-kernel ratio lines, the reported mean, the phase status and the output's tail.

Lines are rows (``text.splitlines`` of captured stdout gives them); parsing is
two regex passes per line, and the last reported mean of a group is its first
row in descending order, which Spark limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gauntlet.functions.classify import perf_run_status
from gauntlet.functions.num import round_to
from gauntlet.functions.text import OUTPUT_TAIL_CHARS, is_noise_line, splitlines, ustrip
from gauntlet.operators.progress import top_k


def stdout_lines(df: DataFrame, keys: list[str], stdout: str = "stdout") -> DataFrame:
    """One row per line of captured stdout, with its 0-based position."""
    return (df.select(*keys, F.posexplode(splitlines(stdout)).alias("pos", "line"))
            .withColumn("pos", F.col("pos").cast("bigint")))


# ---- fixed values (must equal the evaluated pipeline's) -------------------
SPEEDUP_LINE = r"^(\S+):\s+([0-9]*\.?[0-9]+)\s*$"
REPORTED_MEAN_PREFIX = "speed up:"
NUMBER = r"(?i)\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?\z|\A[+-]?(?:inf|infinity|nan)\z"
NO_SURVIVORS_STATUS = "skipped (no surviving operators)"
ALL_SKIPPED_STATUS = "skipped: all perf scripts failed or timed out (%d/%d skipped)"
STDERR_HEADER = "\n[stderr]"
PHASES = ("phase1_call_acc", "phase2_exec_acc", "phase3_efficiency")
# ---------------------------------------------------------------------------
MEASURED = "measured"
TAIL_SALTS = 32


def parse_speedups(lines: DataFrame, line: str = "line") -> DataFrame:
    """``name: ratio`` lines; the ``speed up:`` summary fails the pattern by its space.

    Group 2 needs at least one digit, so an empty extraction means no match:
    two regex passes per line instead of a test plus two extractions.
    """
    pat = "(?U)" + SPEEDUP_LINE.replace("^", r"\A").replace("$", r"\z")
    return (lines.withColumn("_ratio", F.regexp_extract(line, pat, 2)).where(F.col("_ratio") != "")
            .withColumn("name", F.regexp_extract(line, pat, 1))
            .withColumn("ratio", F.col("_ratio").try_cast("double")).drop("_ratio"))


def reported_mean(lines: DataFrame, keys, order) -> DataFrame:
    """Last parseable ``speed up:`` value per group; a number with a type suffix is not one."""
    text = ustrip(F.expr("substr(line, instr(line, ':') + 1)"))
    val = F.when(F.rlike(text, F.lit(NUMBER)), text.try_cast("double"))
    good = lines.where(F.startswith(F.col("line"), F.lit(REPORTED_MEAN_PREFIX))).withColumn("_v", val).where(
        F.col("_v").isNotNull())
    # lines sharing a number keep the text order, as in the assembled stdout
    last = top_k(good, list(keys), [F.col(c).desc() for c in (*order, "line")], 1)
    return last.select(*keys, F.col("_v").alias("mean_speedup"))


def output_tails(lines: DataFrame, keys: list[str], order: list[str], chars: int = OUTPUT_TAIL_CHARS) -> DataFrame:
    """B14 + B15 over lines as rows: the last ``chars`` characters of each group's assembled output.

    ``lines``: keys, stream (``stdout`` or ``stderr``), order columns, line.
    The output is each stdout line with its line feed; if stderr lines other
    than noise are left, a ``[stderr]`` header and those lines follow.

    Every line takes a character at least, so a tail has ``chars`` lines at
    most: the last ones are kept, first per (group, salt) and then per group,
    by running lengths counted from the end.  Spark drops the other rows before
    the shuffle if ``spark.sql.optimizer.windowGroupLimitThreshold`` is at
    least ``chars`` (``get_spark`` sets it); the salts spread a hot group anyway.
    Only what reaches into the tail is gathered, however long a group's output
    or a single line is.
    """
    err = F.col("stream") == "stderr"
    text = F.coalesce(F.col("line"), F.lit(""))
    piece = F.when(err, F.concat(F.lit("\n"), F.right(text, F.lit(chars)))).otherwise(
        F.concat(F.right(text, F.lit(chars)), F.lit("\n")))
    pieces = lines.where(~(err & is_noise_line(text))).select(
        *keys, err.alias("_err"), *order, piece.alias("_piece"),
        F.pmod(F.xxhash64(*order, "stream"), F.lit(TAIL_SALTS)).alias("_salt")).withColumn("_len", F.length("_piece"))
    backwards = [F.col(c).desc() for c in ("_err", *order, "_piece")]
    for group in ([*keys, "_salt"], keys):
        # a frame up to the current row: one that the group limit allows
        so_far = Window.partitionBy(*group).orderBy(*backwards).rowsBetween(Window.unboundedPreceding, 0)
        pieces = (top_k(pieces, group, backwards, chars).withColumn("_behind", F.sum("_len").over(so_far) - F.col("_len"))
                  .where(F.col("_behind") < chars))
    gathered = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col("rn").alias("at"), F.col("_err").alias("err"), F.col("_piece").alias("piece")))).alias("_p"))
    joined = lambda wanted: F.array_join(F.transform(F.filter(F.reverse("_p"), wanted), lambda p: p["piece"]), "")
    tail = F.concat(joined(lambda p: ~p["err"]), F.when(F.exists("_p", lambda p: p["err"]), F.lit(STDERR_HEADER)).otherwise(""),
                    joined(lambda p: p["err"]))
    return gathered.select(*keys, F.right(tail, F.lit(chars)).alias("raw_output_tail"))


def phase_timings(log: DataFrame) -> DataFrame:
    """``timing_s``: seconds (1 digit) of each phase per run; ``log``: run_id, phase, started_s, ended_s.

    A phase that was run again counts with its last run.
    """
    spent = F.col("ended_s") - F.col("started_s")
    of = [round_to(F.max_by(F.when(F.col("phase") == p, spent), F.when(F.col("phase") == p, F.col("ended_s"))), 1)
          .alias(f"{p}_s") for p in PHASES]
    return log.groupBy("run_id").agg(*of)



def perf_completion(runs: DataFrame, runlogs: DataFrame) -> DataFrame:
    """Perf scripts per run, how many were skipped (not OK) or completed, and the phase status.

    ``runs``: run_id, survivors (phase-2 survivors); ``runlogs``: run_id,
    returncode, duration_s.  No survivors and all-skipped get their own texts.
    """
    skipped = perf_run_status("returncode", "duration_s") != "OK"
    c = runlogs.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(skipped).alias("_sk"))
    n, sk = F.coalesce(F.col("_n"), F.lit(0)), F.coalesce(F.col("_sk"), F.lit(0))
    status = (F.when(F.col("survivors") == 0, F.lit(NO_SURVIVORS_STATUS))
              .when(n - sk == 0, F.format_string(ALL_SKIPPED_STATUS, sk, n))
              .otherwise(F.lit(MEASURED)))
    return runs.join(c, "run_id", "left").select(
        "run_id", n.cast("bigint").alias("n_scripts"), sk.cast("bigint").alias("n_skipped"),
        (n - sk).cast("bigint").alias("n_completed"), status.alias("status"))
