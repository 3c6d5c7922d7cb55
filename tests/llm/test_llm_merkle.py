import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from llm_helpers import SCHEMA, docs
from pyspark.sql import functions as F

from gauntlet.llm import merkle_manifest as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    n = None if row["n_chars"] is None else row["n_chars"] + more
    values = (row["doc_id"], row["source"], row["lang"], n, row["text"])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, k=2):
    """Root and, for each leaf, the (before, after) texts of its runs."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(own):
            run = nodes[p // k * k:p // k * k + k]
            paths[i].append(("".join(run[:p % k]), "".join(run[p % k + 1:])))
        nodes = [sha("".join(nodes[i:i + k])) for i in range(0, len(nodes), k)]
        own = [p // k for p in own]
    return nodes[0], paths


def expected(rows, k=2):
    """Per row, in any order: (doc_id, leaf, subroot, root, proof, folded, verified)."""
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append(row)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    subs = {lang: tree([leaf(r) for r in groups[lang]], k) for lang in langs}
    root, tops = tree([subs[lang][0] for lang in langs], k)
    out = []
    for lang, top in zip(langs, tops):
        for row, path in zip(groups[lang], subs[lang][1]):
            touched = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            own = leaf(row, int(touched))
            for before, after in path + top:
                own = sha(before + own + after)
            out.append((row["doc_id"], leaf(row), subs[lang][0], root,
                        sha("".join(b + a for b, a in path + top)), own, own == root))
    return sorted(out, key=str)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_whole_table_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = M.document_manifest(table)
    want = expected(rows_of(table))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {True, False} == {r[-1] for r in want}


def test_nulls_repeats_and_groups_of_one(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 11 == 0 else f"t é {i}", "aa" if i % 3 else None, rng.choice(["s", None]), rng.choice([5, None]))
            for i in range(40)]
    rows += [rows[7]] * 5 + [(7, "other", "aa", None, 1), (None, "x", "aa", "s", 9), (None, None, None, None, None),
             (100, "", "", "s", 0), (101, "alone", "zz", "s", 2**62), (7, "y" * 100_000, "Ä", "s", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in M.document_manifest(df).collect()), key=str)
    assert got == expected(rows_of(df))


def test_one_row_and_no_row(spark):
    one = docs(spark, [(5, "text", "en")])
    (row,) = M.document_manifest(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("")
    assert M.document_manifest(one.where("false")).collect() == []


@pytest.mark.parametrize("k,n", [(3, 28), (4, 17), (5, 5)])
def test_wider_runs(spark, k, n):
    df = docs(spark, [(i, f"d{i}", "en" if i < n - 4 else "fr") for i in range(n)])
    want = {r[0]: (r[1], r[2], r[3], r[4]) for r in expected(rows_of(df), k)}
    got = {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256) for r in M.manifest(df, arity=k).collect()}
    assert got == want
    assert M.manifest(df, arity=k).where("NOT verified").count() == 0


def test_clashing_columns_and_any_change_is_seen(spark):
    df = docs(spark, [(i, f"d{i}", "en") for i in range(9)])
    noisy = df.selectExpr("*", "1 AS pos", "'a' AS hash", "2 AS slot", "'g' AS `group`", "3 AS path", "4 AS _row", "5 AS size")
    plain = {r.doc_id: r.root for r in M.manifest(df).collect()}
    assert {r.doc_id: r.root for r in M.manifest(noisy).collect()} == plain
    touched = M.manifest(noisy, altered={"text": F.when(F.col("doc_id") == 4, F.lit("x")).otherwise(F.col("text"))})
    assert [r.doc_id for r in touched.where("NOT verified").collect()] == [4]


def test_hot_group_is_dealt_over_ranges(spark):
    # one group and one repeated row hold nearly all rows; positions are still 0..n-1 without a gap
    rows = spark.range(6000).selectExpr("CASE WHEN id < 5000 THEN 1 ELSE id END AS `order`", "'en' AS `group`",
                                        "CAST('h' AS BINARY) AS hash", "id AS was")
    table = M.materialise(rows.repartition(8), "test-hot")
    placed = M.tree_positions(table, "group", [F.col("order").asc()])
    assert [r.pos for r in placed.select("pos").orderBy("pos").collect()] == list(range(6000))
    assert {r.size for r in placed.select("size").distinct().collect()} == {6000}
