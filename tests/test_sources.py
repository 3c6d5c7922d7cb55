"""Splittable JSON arrays, the ordered sink, listings by path."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gauntlet.operators import funnel as FN
from gauntlet.session import scratch_dir
from gauntlet.sources import files as IO
from gauntlet.sources import ordered as OR
from gauntlet.sources.json_array import json_array_elements, read_json_array, write_json_arrays

ITEM = T.StructType().add("instruction", T.StringType()).add("input", T.StringType()).add(
    "nested", T.ArrayType(T.StructType().add("a", T.StringType())))


@pytest.fixture
def small_splits(spark):
    """Ranges of 300 bytes, so that strings and elements lie across range borders."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "300")
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def put(spark, text):
    root = scratch_dir(spark, "t-array")
    IO.write_named_files(spark.createDataFrame([("a.json", text)], "name string, text string"), root, "name", "text")
    return root


def random_items(rng, n):
    piece = lambda: "".join(rng.choice(["}", "{", "]", "[", '"', "\\", "\n", ",", " ", "é", "x" * 20, "😀", '\\"}', ":"])
                            for _ in range(rng.randrange(14)))
    return [{"instruction": piece(), "input": rng.choice([None, piece()]), "nested": [{"a": piece()} for _ in range(rng.randrange(3))]}
            for _ in range(n)]


@pytest.mark.parametrize("indent,ascii_", [(None, True), (2, False)])
def test_arrays_are_read_by_ranges(spark, small_splits, indent, ascii_):
    rng = random.Random(7)
    items = random_items(rng, 300)
    root = put(spark, json.dumps(items, indent=indent, ensure_ascii=ascii_))
    assert spark.read.option("lineSep", "}").text(root).rdd.getNumPartitions() > 20
    got = {r.idx: r for r in read_json_array(spark, root, ITEM).collect()}
    assert sorted(got) == list(range(len(items)))
    for i, item in enumerate(items):
        assert got[i].instruction == item["instruction"] and got[i].input == item["input"]
        assert [x.a for x in got[i].nested] == [x["a"] for x in item["nested"]]


def test_empty_arrays_and_several_files(spark, small_splits):
    for text in ("[]", " [ \n ]\n"):
        assert json_array_elements(spark, put(spark, text)).count() == 0
    roots = [put(spark, json.dumps([{"instruction": f"{k}-{i}"} for i in range(40)])) for k in range(3)]
    rows = read_json_array(spark, roots, ITEM).collect()
    assert sorted((r.instruction.split("-")[1], r.idx) for r in rows) == sorted((str(i), i) for i in range(40) for _ in range(3))


@pytest.mark.parametrize("text", ['[{"instruction": "a"}', '[{"instruction": "a"', '[{"instruction": "a}]', '{"instruction": "a"}]',
                                  '[{"instruction": "a"},]', '[{"instruction": "a"} {"instruction": "b"}]', '[{"instruction": "a"}}]',
                                  '[{"instruction": "a"}] x', '[1, {"instruction": "a"}]', '[{"instruction": "a"}, 2]', '[{"instruction": }]',
                                  '[{"instruction": "a"}][]', '[[{"instruction": "a"}]]', '{}', 'x'])
def test_broken_arrays_raise(spark, text):
    with pytest.raises(Exception):
        read_json_array(spark, put(spark, text), ITEM).collect()


def test_array_round_trip_keeps_order_and_nulls(spark):
    rows = spark.range(500).select(F.lit("all").alias("g"), (499 - F.col("id")).alias("idx"), F.concat(F.lit("t}"), "id").alias("instruction"),
                                   F.when(F.col("id") % 2 == 0, F.lit("")).alias("input"))
    root = scratch_dir(spark, "t-written")
    write_json_arrays(rows.repartition(4), root, "g", ["all", "none"], ["idx"])
    (text,) = (r.value for r in spark.read.text(f"{root}/g=all", wholetext=True).collect())
    assert read_json_array(spark, f"{root}/g=none", ITEM).count() == 0
    assert [x["instruction"] for x in json.loads(text)] == [f"t}}{499 - i}" for i in range(500)]
    got = {r.idx: (r.instruction, r.input) for r in read_json_array(spark, f"{root}/g=all", ITEM).collect()}
    assert got == {499 - i: (f"t}}{i}", "" if i % 2 == 0 else None) for i in range(500)}


def test_a_large_array_is_written_by_ranges(spark, small_splits):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, "simp").otherwise("comp").alias("dataset"), (F.col("id") * 7919 % 10007).alias("idx"),
                                    F.concat(F.lit('t},"{['), "id").alias("instruction"), F.when(F.col("id") % 2 == 0, "é\n").alias("input"))
    root = scratch_dir(spark, "t-ranges")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        IO.write_task_arrays(rows, root, datasets=("simp", "comp"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {d: [(r.instruction, r.input) for r in sorted(rows.where(F.col("dataset") == d).collect(), key=lambda r: r.idx)] for d in ("simp", "comp")}
    for d in want:
        files = sorted(spark.read.text(f"{root}/dataset={d}", wholetext=True).select("_metadata.file_name", "value").collect())
        parts = [json.loads(r.value) for r in files]
        assert [(x["instruction"], x["input"]) for part in parts for x in part] == want[d]
        assert len(parts) > 1 and max(map(len, parts)) < 0.9 * len(want[d])
    got = IO.read_task_arrays(spark, root).collect()
    assert sorted((r.dataset, r.idx, r.instruction, r.input) for r in got) == sorted((d, i, *x) for d in want for i, x in enumerate(want[d]))
    assert sorted(r.idx for r in IO.read_task_file(spark, f"{root}/dataset=simp", "simp").collect()) == list(range(1500))


def test_ordered_sink_gives_places_without_a_sort(spark, small_splits):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("idx"), F.concat(F.lit("é "), "id").alias("instruction"),
                                    F.when(F.col("id") % 3 > 0, F.repeat(F.lit("p"), (F.col("id") % 50).cast("int"))).alias("predict"))
    root = scratch_dir(spark, "t-ordered")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    OR.write_ordered_jsonl(rows, root, ["idx"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    out = OR.read_ordered_jsonl(spark, root, IO.PREDICTION)
    got = {r.pos: (r.instruction, r.predict) for r in out.collect()}
    assert got == {r.idx: (r.instruction, r.predict) for r in rows.collect()}
    manifest = sorted(OR.read_manifest(spark, root).collect(), key=lambda r: r.part)
    assert len(manifest) > 1 and [r.first_pos for r in manifest] == [sum(x.n_rows for x in manifest[:k]) for k in range(len(manifest))]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_unfinished_or_changed_folders_raise(spark):
    root = scratch_dir(spark, "t-unfinished")
    spark.range(3).select(F.lit("a").alias("instruction")).write.json(root)
    with pytest.raises(FileNotFoundError):
        OR.read_ordered_jsonl(spark, root, IO.PREDICTION)
    root = scratch_dir(spark, "t-changed")
    OR.write_ordered_jsonl(spark.range(30).select("id", F.lit("a").alias("instruction")), root, ["id"])
    spark.range(2).select(F.lit("b").alias("instruction")).write.mode("append").json(root)
    with pytest.raises(Exception, match="not as the manifest says"):
        OR.read_ordered_jsonl(spark, root, IO.PREDICTION).collect()
    empty = scratch_dir(spark, "t-empty")
    OR.write_ordered_jsonl(spark.range(0).select("id", F.lit("a").alias("instruction")), empty, ["id"])
    assert OR.read_ordered_jsonl(spark, empty, IO.PREDICTION).count() == 0


def test_survivors_by_listing(spark):
    root = scratch_dir(spark, "t-listing")
    names = ["r1/a.py", "r1/sub/a.py", "r1/b c+.py", "r2/a.py", "r2/ghost.py", "r1/notes.txt"]
    IO.write_named_files(spark.createDataFrame([(n, "#") for n in names], "name string, text string"), root, "name", "text")
    listing = IO.read_listing(spark, root)
    assert sorted(map(tuple, listing.collect())) == [("r1", "a.py"), ("r1", "a.py"), ("r1", "b c+.py"), ("r2", "a.py"), ("r2", "ghost.py")]
    items = spark.createDataFrame([("r1", "a.py"), ("r1", "a.py"), ("r1", "b c+.py"), ("r1", "d.py"), ("r2", "a.py"), ("r3", "a.py")],
                                  "run_id string, kernel_id string")
    assert sorted(map(tuple, FN.survivors(items, listing).collect())) == [
        ("r1", "a.py"), ("r1", "a.py"), ("r1", "b c+.py"), ("r2", "a.py")]
    assert IO.read_listing(spark, scratch_dir(spark, "t-missing")).count() == 0


def test_folders_of_many_files_are_listed_and_read_in_tasks(spark):
    root = scratch_dir(spark, "t-many")
    names = [f"r{i % 3}/s{i % 2}/k{i}.py" for i in range(300)] + ["r0/empty.py", "r0/.hidden.py", "_tmp/x.py", "r1/notes.txt", "top.py"]
    rows = spark.createDataFrame([(n, "" if "empty" in n else f"é {n}") for n in names], "name string, text string")
    IO.write_named_files(rows, root, "name", "text")
    listing, corpus = IO.read_listing(spark, root), IO.read_corpus(spark, root, recursive=True)
    for df in (listing, corpus):                    # no file index of the folder, which the driver would hold
        assert root.rsplit("/", 1)[1] not in df._jdf.queryExecution().optimizedPlan().toString()
        assert "binaryFile" not in df._jdf.queryExecution().executedPlan().toString()
        assert not [f for f in df.inputFiles() if root in f]
    kept = [n for n in names if n.startswith("r") and n.endswith(".py") and "empty" not in n and "hidden" not in n]
    assert sorted(map(tuple, listing.collect())) == sorted((n.split("/")[0], n.split("/")[-1]) for n in kept + ["top.py"])
    assert {r.path.split(root.split(":")[-1])[1].strip("/"): r.source for r in corpus.collect()} == {n: f"é {n}" for n in kept + ["top.py"]}
    assert [r.kernel_id for r in IO.read_corpus(spark, root).collect()] == ["top.py"]
    assert all(r.path.startswith("file:///") for r in corpus.collect())


def test_files_with_one_text_share_a_block(spark):
    root, at = scratch_dir(spark, "t-links"), {}
    rows = [(f"r{i % 2}/k{i}.py", "#\n") for i in range(200)] + [("r0/own.py", "own"), ("r0/twice.py", "#\n"), ("r0/twice.py", "#\n")]
    IO.write_named_files(spark.createDataFrame(rows, "name string, text string").coalesce(1), root, "name", "text")
    folder = root.split(":")[-1]
    for name, text in rows:
        assert open(f"{folder}/{name}").read() == text
        at[name] = os.stat(f"{folder}/{name}").st_ino
    assert len(set(at.values())) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) < len(at)
    # a file written again changes alone, and nothing but the files is left
    IO.write_named_files(spark.createDataFrame([("r0/k0.py", "new"), ("r1/k1.py", "#\n")], "name string, text string"), root, "name", "text")
    assert {n: open(f"{folder}/{n}").read() for n in at} == {**dict(rows), "r0/k0.py": "new"}
    assert sorted(x for _, _, names in os.walk(folder) for x in names) == sorted(n.split("/")[1] for n in at)


def test_a_file_is_written_where_links_fail(tmp_path, monkeypatch):
    def refuse(a, b):
        if os.path.exists(b):
            raise FileExistsError(b)
        raise OSError(31, "Too many links")

    write = IO._local_writer()
    monkeypatch.setattr(os, "link", refuse)
    for name, text in [("a", b"x"), ("b", b"x"), ("a", b"y"), ("b", b"y"), ("c", b"")]:
        write(str(tmp_path / name), text)
    assert {n: (tmp_path / n).read_bytes() for n in os.listdir(tmp_path)} == {"a": b"y", "b": b"y", "c": b""}
