"""An ordered JSONL sink with a manifest, and a reader that gives rows their place.

Rows are range-partitioned by their order and sorted within ranges, so the
files' numbers follow the order and no task holds more than a range.  The
manifest has a row per file: its number, rows and first position; it is
written last, so a folder without one was not finished.

Lines carry no index of their own.  A row's place is the file's first position,
plus the lines of the byte ranges before its own, plus its place in that
range: counts of a row per byte range, and no sort of the rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "_manifest"          # readers of the data leave out names with a leading underscore
MANIFEST_SCHEMA = "file string, part long, n_rows long, first_pos long"
UP_TO_BEFORE = (Window.unboundedPreceding, -1)


def _file_and_part() -> tuple[Column, Column]:
    name = F.col("_metadata.file_name")
    return name.alias("file"), F.regexp_extract(name, r"\Apart-(\d+)", 1).cast("long").alias("part")


def write_ordered_jsonl(rows: DataFrame, root: str, order: list[str], keep_nulls: bool = False) -> None:
    """Write the columns other than ``order`` as JSON lines in that order, and the manifest."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.drop(*order).write.mode("overwrite").option("ignoreNullFields", str(not keep_nulls).lower()).json(root)
    counts = spark.read.text(root).select(*_file_and_part()).groupBy("file", "part").agg(F.count(F.lit(1)).alias("n_rows"))
    first = F.coalesce(F.sum("n_rows").over(Window.orderBy("part").rowsBetween(*UP_TO_BEFORE)), F.lit(0))   # a row per file
    counts.withColumn("first_pos", first).coalesce(1).write.mode("overwrite").json(f"{root}/{MANIFEST}")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST_SCHEMA).option("mode", "FAILFAST").json(f"{root}/{MANIFEST}")
    except AnalysisException as exc:
        raise FileNotFoundError(f"{root} has no manifest: the write did not finish") from exc


def read_ordered_jsonl(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """``pos`` (from 0, in the written order) and the fields of every line.

    A line that does not fit the schema raises, and so does a file whose
    number of lines is not the manifest's.
    """
    manifest = read_manifest(spark, root)
    lines = spark.read.text(root).select(*_file_and_part(), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("_at"), "value")
    blocks = lines.groupBy("file", "block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("file")
    blocks = blocks.select("file", "block", "_first", F.sum("_n").over(own).alias("_lines"),
                           F.coalesce(F.sum("_n").over(own.orderBy("block").rowsBetween(*UP_TO_BEFORE)), F.lit(0)).alias("_before"))
    starts = blocks.join(manifest.drop("part"), "file", "left").select(
        "file", "block", (F.when(F.col("n_rows") == F.col("_lines"), F.col("first_pos"))
                          .otherwise(F.raise_error(F.concat(F.lit("not as the manifest says: "), F.col("file"))))
                          + F.col("_before") - F.col("_first")).alias("_shift"))
    return lines.join(starts, ["file", "block"]).select(
        (F.col("_shift") + F.col("_at")).alias("pos"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_r")).select("pos", "_r.*")
