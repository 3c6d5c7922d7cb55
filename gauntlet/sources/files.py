"""File sources and sinks: JSON-array task files, JSONL, whole-text corpora, sidecars.

All paths live under the shared checkpoint folder (``session.scratch_dir``).
Readers keep the reference's formats (a JSON array per file, one record per
JSONL line, one module per ``.py`` file) and spread files over tasks; nothing
is read through the driver.  Folders of many small files are listed by tasks
too, so the driver never holds their names.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import suppress
from fnmatch import fnmatchcase
from itertools import islice
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from gauntlet.session import scratch_dir
from gauntlet.sources.json_array import read_json_array, write_json_arrays

TASK_ITEM = T.StructType([T.StructField("instruction", T.StringType()), T.StructField("input", T.StringType())])
PREDICTION = T.StructType([T.StructField("instruction", T.StringType()), T.StructField("predict", T.StringType())])
VALID_DATASETS = ("simp", "comp")


def _local(path: str) -> str:
    for prefix in ("file://", "file:"):
        if path.startswith(prefix):
            return path[len(prefix):]
    return path


# ---- A1: task arrays --------------------------------------------------------------

def write_task_arrays(tasks: DataFrame, root: str, datasets=VALID_DATASETS) -> None:
    """A dataset's JSON array in ``root/dataset=<name>``, items in the order of ``idx``; a large one is cut into
    consecutive arrays, a file each."""
    write_json_arrays(tasks.select("dataset", "idx", "instruction", "input"), root, "dataset", list(datasets), ["idx"])


def read_task_file(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """A1: one JSON array per dataset; the index is the array position, counted on through a folder's files.

    The array is read by byte ranges (``json_array``), so a large file has
    many tasks; a broken array raises.
    """
    if dataset not in VALID_DATASETS:
        raise ValueError(f"dataset must be one of {VALID_DATASETS}, got {dataset!r}")
    items = read_json_array(spark, path, TASK_ITEM, across_files=True)
    return items.select(F.lit(dataset).alias("dataset"), F.col("idx").cast("bigint").alias("idx"), "instruction", "input")


def read_task_arrays(spark: SparkSession, root: str, datasets=VALID_DATASETS) -> DataFrame:
    """A1 for several datasets under one folder: their files are read together, each by its ranges."""
    bad = [d for d in datasets if d not in VALID_DATASETS]
    if bad:
        raise ValueError(f"dataset must be one of {VALID_DATASETS}, got {bad}")
    items = read_json_array(spark, [f"{root}/dataset={name}" for name in datasets], TASK_ITEM, across_files=True)
    dataset = F.regexp_extract("file", r"/dataset=([^/]*)/[^/]*\z", 1)
    return items.select(dataset.alias("dataset"), F.col("idx").cast("bigint").alias("idx"), "instruction", "input")


# ---- folders of many files ---------------------------------------------------------

LISTED = "path string, below string, size long, is_dir boolean"
LIST_ROWS, READ_ROWS, READ_BYTES = 10_000, 1_000, 8 << 20   # a batch of names; of texts


def _filesystem(root: str):
    """Arrow's file system of a folder, and its path there."""
    import pyarrow.fs as pafs
    base = _local(root).rstrip("/")
    if "://" not in base:
        return pafs.LocalFileSystem(), base
    # Hadoop's s3a scheme is plain s3 for Arrow's filesystem layer
    return pafs.FileSystem.from_uri("s3://" + base[len("s3a://"):] if base.startswith("s3a://") else base)


def _for_tasks(root: str) -> bool:
    """Whether tasks can open the folder themselves; other stores are left to Spark's readers."""
    try:
        _filesystem(root)
        return True
    except (pa.ArrowInvalid, OSError):
        return False


def _hidden(name: str) -> bool:
    """Names that Spark's file sources leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(fs, folder: str, local: bool) -> Iterator[tuple[str, int, bool]]:
    """name, size and whether it is a folder; a local folder is streamed however long it is."""
    if local:
        with os.scandir(folder) as found:
            for e in found:
                is_dir = e.is_dir()
                yield e.name, 0 if is_dir else e.stat().st_size, is_dir
    else:
        import pyarrow.fs as pafs
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            yield info.base_name, info.size or 0, info.type == pafs.FileType.Directory


def list_files(spark: SparkSession, root: str, recursive: bool, glob: str) -> DataFrame | None:
    """path (as the file system names it) and below (the path below ``root``) of every file with a matching name.

    Tasks list the folders, one level of folders after another, and write what
    they find to the scratch folder.  As in Spark's file sources, hidden names and empty files are left
    out.  None if ``root`` is missing.
    """
    import pyarrow.fs as pafs
    fs, top = _filesystem(root)
    if fs.get_file_info([top])[0].type == pafs.FileType.NotFound:
        return None
    local = "://" not in _local(root)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(root)
        for batch in batches:
            for path, below in zip(*(batch.column(c).to_pylist() for c in ("path", "below"))):
                rows = ((f"{path}/{name}", f"{below}{name}", size, is_dir) for name, size, is_dir in _entries(fs, path, local)
                        if not _hidden(name) and (is_dir if not size else not is_dir and fnmatchcase(name, glob)))
                while part := list(islice(rows, LIST_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.string(), pa.string(), pa.int64(), pa.bool_()))],
                                                     ["path", "below", "size", "is_dir"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, levels = spark.createDataFrame([(top, "")], "path string, below string"), []
    while True:
        at = scratch_dir(spark, "listing")
        folders.repartition(parts, "path").mapInArrow(found, LISTED).write.parquet(at)
        levels.append(at)
        folders = spark.read.schema(LISTED).parquet(at).where("is_dir").select("path", F.concat("below", F.lit("/")).alias("below"))
        if not recursive or folders.isEmpty():
            return spark.read.schema(LISTED).parquet(*levels).where("NOT is_dir").select("path", "below")


def _texts(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """path and value (the whole text) of listed files, dealt over tasks by their paths."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(root)

        def batch_of(paths, texts):
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], ["path", "value"])

        for batch in batches:
            paths, texts, held = [], [], 0
            for path in batch.column("path").to_pylist():
                with fs.open_input_stream(path) as fh:
                    texts.append(fh.read())
                paths.append(path)
                held += len(texts[-1])
                if len(paths) >= READ_ROWS or held >= READ_BYTES:
                    yield batch_of(paths, texts)
                    paths, texts, held = [], [], 0
            if paths:
                yield batch_of(paths, texts)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = _local(root)
    scheme = f"{urlsplit(base).scheme}://" if "://" in base else "file://"
    return files.select("path").repartition(parts, "path").mapInArrow(read, "path string, value binary").select(
        F.concat(F.lit(scheme), "path").alias("path"), F.col("value").cast("string").alias("value"))


# ---- C10: listings ----------------------------------------------------------------

def read_listing(spark: SparkSession, root: str, suffix: str = ".py") -> DataFrame:
    """The files with a suffix below a folder by path alone: run_id (the folder's name) and kernel_id (the file's).

    Nothing of a file is read.  A name that stands in several subfolders of a
    run comes several times; a missing folder has no files.  Spark's file
    sources leave out empty files, and so does the listing.
    """
    if _for_tasks(root):
        files = list_files(spark, root, recursive=True, glob="*")
        if files is None:
            return spark.createDataFrame([], "run_id string, kernel_id string")
        path, below = F.col("path"), F.col("below")
    else:
        if not has_files(spark, root):
            return spark.createDataFrame([], "run_id string, kernel_id string")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
        path, below = F.col("path"), F.substring_index("path", f"{_local(root).rstrip('/')}/", -1)
    return files.where(F.endswith(path, F.lit(suffix))).select(
        F.split_part(below, F.lit("/"), F.lit(1)).alias("run_id"), F.substring_index(below, "/", -1).alias("kernel_id"))


# ---- A2 / A9: JSONL ---------------------------------------------------------------

def write_jsonl(df: DataFrame, root: str, keep_nulls: bool = True) -> None:
    """JSON lines, non-ASCII kept as is, null fields written (the default drops them)."""
    df.write.mode("overwrite").option("ignoreNullFields", str(not keep_nulls).lower()).json(root)


def write_run_partitions(df: DataFrame, root: str, by: str = "run_id") -> None:
    """Replace only the runs present in ``df``; partitions of other runs stay as written."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(root)


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """A2: explicit schema, a malformed line fails the read; missing ``predict`` -> ''."""
    df = spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(root)
    return df.select("instruction", F.coalesce(F.col("predict"), F.lit("")).alias("predict"))


# ---- A3 / A4: whole-text corpora ----------------------------------------------------

def _local_writer():
    """A function that writes a text to a path of the local file system.

    A file with the text of the one before it becomes another name of that one (a hard link), so many small files
    with one text take names but not a block each.  A file that is there is replaced, not written into, as it may
    have other names.
    """
    last_path, last_text = "", None

    def write(path: str, text: bytes) -> None:
        nonlocal last_path, last_text

        def make(at: str) -> None:
            nonlocal last_path, last_text
            if text == last_text:
                try:
                    return os.link(last_path, at)
                except FileExistsError:
                    raise
                except OSError:            # no links here, or no more of them to one file
                    pass
            with open(at, "xb") as fh:
                fh.write(text)
            last_path, last_text = path, text

        try:
            make(path)
        except FileExistsError:
            folder, name = os.path.split(path)
            new = f"{folder}/.{name}.{uuid.uuid4().hex}"
            make(new)
            os.replace(new, path)
            with suppress(FileNotFoundError):   # a name of the same file is not moved
                os.remove(new)

    return write


def write_named_files(df: DataFrame, root: str, name_col: str, text_col: str) -> int:
    """Write each row's text to ``root/<name>``; runs in the tasks, returns the file count.

    The rows are dealt over all tasks by name, as their source may have few splits.
    """

    def writer(batches):
        fs, prefix = _filesystem(root)
        write = _local_writer() if "://" not in _local(root) else None
        made = set()
        for pdf in batches:
            for name, text in zip(pdf[name_col], pdf[text_col]):
                path = f"{prefix}/{name}"
                parent = path.rsplit("/", 1)[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                data = (text or "").encode("utf-8")
                if write:
                    write(path, data)
                else:
                    with fs.open_output_stream(path) as fh:
                        fh.write(data)
            yield pd.DataFrame({"n": [len(pdf)]})

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.select(name_col, text_col).repartition(parts, name_col).mapInPandas(writer, "n long").agg(F.sum("n")).first()[0]
    return int(out or 0)


def _input_path():
    """The file a row comes from, as it is named (Spark gives it URL-encoded)."""
    return F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))


def read_corpus(spark: SparkSession, root: str, recursive: bool = False, glob: str = "*.py") -> DataFrame:
    """A3: every matching file as (path, kernel_id, source), whole text per file."""
    if _for_tasks(root):
        files = list_files(spark, root, recursive, glob)
        if files is None or files.isEmpty():
            raise FileNotFoundError(f"no {glob} files under {root}")
        df, path = _texts(spark, files, root), F.col("path")
    else:
        reader = spark.read.option("pathGlobFilter", glob)
        if recursive:
            reader = reader.option("recursiveFileLookup", "true")
        df, path = reader.text(root, wholetext=True), _input_path()
        if df.isEmpty():
            raise FileNotFoundError(f"no {glob} files under {root}")
    return df.select(path.alias("path"), F.regexp_extract(path, r"([^/]*)\z", 1).alias("kernel_id"),
                     F.col("value").alias("source"))


def read_corpus_with_fallback(spark: SparkSession, primary: str, fallback: str, glob: str = "*.py") -> DataFrame:
    """A4: recursive scan of ``primary``; if it is missing or holds no matching file, scan ``fallback``."""
    for root in (primary, fallback):
        if _for_tasks(root) or has_files(spark, root):
            try:
                return read_corpus(spark, root, recursive=True, glob=glob)
            except FileNotFoundError:
                pass
    raise FileNotFoundError(f"no {glob} files under {primary} or {fallback}")


def has_files(spark: SparkSession, root: str) -> bool:
    """Whether ``root`` exists: resolving a reader on a missing path raises at once, reading nothing."""
    try:
        spark.read.format("text").load(root)
        return True
    except AnalysisException:
        return False


# ---- A5: optional sidecars ------------------------------------------------------------

def read_sidecars(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """A5: one JSON document per file; unreadable documents come back as null, not errors."""
    full = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
    if not has_files(spark, root):
        return spark.createDataFrame([], T.StructType([T.StructField("path", T.StringType())] + full.fields))
    df = (spark.read.schema(full).option("mode", "PERMISSIVE").option("multiLine", "true")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(root))
    ok = F.col("_corrupt_record").isNull()
    return df.select(_input_path().alias("path"),
                     *[F.when(ok, F.col(f.name)).alias(f.name) for f in schema.fields],
                     "_corrupt_record")
