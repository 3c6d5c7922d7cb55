"""A splittable reader of large JSON arrays of objects (A1).

A JSON array is one value, so Spark's JSON source gives a whole file to one
task.  Here the text source cuts a file at every ``}`` instead, which splits
at any byte range.  Whether such a brace closes an element depends on what
stands before it, so string and bracket state is carried over ranges by a
parallel scan: every segment states how it changes the state, segments are
summed within their range, and the ranges' totals become each range's start.

* quotes that no backslash escapes toggle "inside a string" (JSON has no
  escaped brace, so no escape sequence is cut);
* brackets outside strings change the depth, counted for either start state;
* a brace that brings the depth back to 1 closes an element, and the number
  of closed ones before a segment is its element's index.

An element's segments are joined (their number is the braces of one element),
and its text is parsed with the caller's schema.  A broken array raises:
unbalanced brackets or strings, anything but a comma between elements,
elements that are not objects, text after the end, and fields that do not fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gauntlet.session import scratch_dir

BROKEN = "broken JSON array: "
BATCH_ITEMS = 256      # items joined with their commas at a time


def _count(text: Column, characters: str) -> Column:
    """How many bytes of the text are one of the (ASCII) characters."""
    rest = reduce(lambda t, ch: F.replace(t, F.lit(ch), F.lit("")), characters, text)
    return F.octet_length(text) - F.octet_length(rest)


def _segments(spark: SparkSession, paths) -> DataFrame:
    """file, block, at (order within the range), text: what stands between two closing braces."""
    raw = spark.read.option("lineSep", "}").text(paths)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))


def _states(segments: DataFrame) -> DataFrame:
    """file, block, at of every segment with the state it starts in: _depth, _inside a string, idx, _is_last.

    One pass over the text leaves a few numbers per segment, which are written
    to the shared scratch folder; all windows read those.  They run within a
    byte range, which the split size bounds; the ranges' totals, a row each,
    are summed per file.
    """
    opened = lambda text: _count(text, "{[") - _count(text, "]")
    steps = (segments.withColumn("_plain", F.regexp_replace("text", r"(?s)\\.", ""))          # without escape sequences
             .withColumn("_out", F.regexp_replace("_plain", '"[^"]*(?:"|\\z)', ""))
             .withColumn("_in", F.regexp_replace(F.regexp_replace("_plain", '\\A[^"]*(?:"|\\z)', ""), '"[^"]*(?:"|\\z)', ""))
             .select("file", "block", "at", _count(F.col("_plain"), '"').alias("_quotes"), opened(F.col("_out")).alias("_if_out"),
                     opened(F.col("_in")).alias("_if_in")))
    path = scratch_dir(segments.sparkSession, "array-states")
    steps.write.parquet(path)
    rows = segments.sparkSession.read.schema(steps.schema).parquet(path)

    in_range = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    in_file = Window.partitionBy("file").orderBy("block")
    ranges_before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.sum(c).over(in_range) - F.col(c)
    before = lambda c: F.coalesce(F.sum(c).over(ranges_before), F.lit(0))
    rows = rows.withColumn("_q", so_far("_quotes"))
    # a range's change of depth, for either state at its start
    ends_out = (F.col("_q") + F.col("_quotes")) % 2 == 0
    from_out = F.when(F.col("_q") % 2 == 0, F.col("_if_out")).otherwise(F.col("_if_in")) - F.when(ends_out, 1).otherwise(0)
    from_in = F.when(F.col("_q") % 2 == 0, F.col("_if_in")).otherwise(F.col("_if_out")) - F.when(ends_out, 0).otherwise(1)
    ranges = rows.groupBy("file", "block").agg(F.sum("_quotes").alias("_qs"), F.sum(from_out).alias("_d_out"),
                                               F.sum(from_in).alias("_d_in"), F.max("at").alias("_max_at"))
    ranges = ranges.withColumn("_parity", before("_qs") % 2).withColumn(
        "_d", F.when(F.col("_parity") == 0, F.col("_d_out")).otherwise(F.col("_d_in")))
    ranges = ranges.select("file", "block", "_parity", before("_d").alias("_start"),
                           F.when(F.lead("block").over(in_file).isNull(), F.col("_max_at")).alias("_last"))

    rows = rows.join(ranges, ["file", "block"])
    # what follows the last brace ends with the file, not with a brace
    is_last = F.col("at") == F.coalesce("_last", F.lit(-1))
    closes = ~is_last & ((F.col("_parity") + F.col("_q") + F.col("_quotes")) % 2 == 0)
    rows = rows.withColumns({"_is_last": is_last, "_inside": (F.col("_parity") + F.col("_q")) % 2 == 1, "_closes": closes.cast("int")})
    rows = rows.withColumn("_delta", F.when(F.col("_inside"), F.col("_if_in")).otherwise(F.col("_if_out")) - F.col("_closes"))
    rows = rows.withColumn("_depth", F.col("_start") + so_far("_delta"))
    rows = rows.withColumn("_ends", ((F.col("_closes") == 1) & (F.col("_depth") + F.col("_delta") == 1)).cast("int"))
    rows = rows.withColumn("_closed", so_far("_ends"))
    # the elements of the files before this one in its folder: a row per range is counted
    in_folder = Window.partitionBy(F.regexp_extract("file", r"\A(.*)/", 1)).orderBy("file").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    closed = rows.groupBy("file", "block").agg(F.sum("_ends").alias("_n")).select(
        "file", "block", before("_n").alias("_closed_before"),
        (F.sum("_n").over(in_folder) - F.sum("_n").over(Window.partitionBy("file"))).alias("_files_before"))
    return rows.join(closed, ["file", "block"]).select(
        "file", "block", "at", "_depth", "_inside", "_is_last", (F.col("_closed") + F.col("_closed_before")).alias("idx"), "_files_before")


def json_array_elements(spark: SparkSession, paths, across_files: bool = False) -> DataFrame:
    """file, idx (from 0, per file) and text of every element of the files' arrays, each an object.

    ``across_files``: idx counts on through the files of a folder, in the order of their names.
    """
    segments = _segments(spark, paths)
    steps = segments.join(_states(segments), ["file", "block", "at"])
    broken = lambda why: F.raise_error(F.concat(F.lit(BROKEN + why + " in "), F.col("file")))
    # what is left after the last element closes the array, or is a whole empty one
    rest_ok = F.when(F.col("_depth") == 0, F.rlike("text", F.lit(r"\A\s*\[\s*\]\s*\z"))).otherwise(
        (F.col("_depth") == 1) & ~F.col("_inside") & F.rlike("text", F.lit(r"\A\s*\]\s*\z")))
    elements = steps.groupBy("file", "idx").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("_parts"),
        F.max(F.when(F.col("_is_last"), F.when(rest_ok, F.lit(0)).otherwise(F.lit(1)))).alias("_rest"),
        F.max("_files_before").alias("_files_before"))
    text = F.array_join(F.transform("_parts", lambda p: p["text"]), "}")
    # the file's rest has no element; if it shares a group with segments, an element was not closed
    rest = F.col("_rest").isNotNull()
    opening = F.when(F.col("idx") == 0, F.rlike(text, F.lit(r"\A\s*\[\s*\{"))).otherwise(F.rlike(text, F.lit(r"\A\s*,\s*\{")))
    value = (F.when(rest & ((F.col("_rest") == 1) | (F.size("_parts") > 1)), broken("it does not end as an array"))
             .when(rest, F.lit(None).cast("string"))
             .when(~opening, broken("something else than an object or a comma"))
             .otherwise(F.concat(F.regexp_replace(text, r"\A\s*[\[,]\s*", ""), F.lit("}"))))
    place = F.col("idx") + F.col("_files_before") if across_files else F.col("idx")
    return elements.select("file", place.alias("idx"), value.alias("text")).where(F.col("text").isNotNull())


def read_json_array(spark: SparkSession, paths, schema: T.StructType, across_files: bool = False) -> DataFrame:
    """file, idx and the elements' fields; an element that does not fit the schema raises."""
    parsed = json_array_elements(spark, paths, across_files).select("file", "idx", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("_e"))
    return parsed.select("file", "idx", "_e.*")


def write_json_arrays(rows: DataFrame, root: str, by: str, groups: list[str], order: list[str]) -> None:
    """The other columns of each group, in the order of ``order``, as JSON arrays in ``root/<by>=<group>``, nulls kept.

    A group is range-partitioned by its order (rows of the same place: by a hash of their text), and each task writes
    its range as an array of its own, streaming sorted rows; so no task holds more than a range, and the arrays' file
    names follow the order.  A small group is one range and one array; one without rows gets an empty array.
    """
    spark = rows.sparkSession
    fields = [c for c in rows.columns if c not in (by, *order)]
    tie = "_tie" + "_" * max(map(len, order), default=0)
    for group in groups:
        items = rows.where(F.col(by) == group).select(*order, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
        # a row of no item: the task that gets it writes an array even if no item comes its way
        mark = spark.range(1).select(*(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order), F.lit(None).cast("string").alias("value"))
        keyed = items.unionByName(mark).withColumn(tie, F.xxhash64("value"))
        ranged = keyed.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
        ranged.select("value").mapInArrow(_bracketed, "value string").write.mode("overwrite").text(f"{root}/{by}={group}")


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one array: its brackets, and a comma before every item but the first; nothing for no rows."""
    lead = None
    for batch in batches:
        for at in range(0, len(batch), BATCH_ITEMS):
            items = batch.column("value").slice(at, BATCH_ITEMS).drop_null()
            if lead is None:
                yield pa.RecordBatch.from_arrays([pa.array(["["])], ["value"])
                lead = ""
            if len(items):
                first = pa.array([lead] + [","] * (len(items) - 1))
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(first, items.cast(pa.string()), "")], ["value"])
                lead = ","
    if lead is not None:
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])
