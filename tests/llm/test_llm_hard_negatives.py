import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gauntlet.llm import hard_negatives as M

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """The query's result rows, by scoring every pair."""
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(x)) for x in v)))
    out = []
    for i, label, v in sorted(set(k for k in kept if k[0] % 100 == 0)):
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in kept]
        positives = sorted((s, j) for s, j, other in scored if other == label and j != i)[:5]
        for p, j in positives:
            fits = sorted((s, n) for s, n, other in scored if other != label and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(fits, 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in M.mine_embeddings(df).collect())


def as_float(x):
    return None if x is None else float(np.float32(x))


def table(spark, rows):
    rows = [(i, None if v is None else [as_float(x) for x in v], label) for i, v, label in rows]
    return rows, spark.createDataFrame(rows, SCHEMA)


def vectors(rng, n, width=12, spread=1.0):
    return [(i, [rng.gauss(0, spread) for _ in range(width)], rng.randrange(10)) for i in range(n)]


def test_whole_table_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert mined(df) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


@pytest.mark.parametrize("block_rows", [16, 100, 5000])
def test_blocks_do_not_change_the_result(spark, block_rows):
    rows, df = table(spark, vectors(random.Random(1), 700))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = M.mine_hard_negatives(M.quantised(df, label), F.col("vec_id") % 100 == 0, block_rows=block_rows)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_ties_nulls_repeats_and_odd_lengths(spark):
    rng = random.Random(2)
    rows = vectors(rng, 300)
    rows += [(i, [1.0] * 12, i % 4) for i in range(1000, 1150)]                    # one vector for many ids
    rows += [(400, [0.5, -0.25], 3), (500, [], 2), (600, [0.0] * 12, 1), (700, [3.0] * 20, 0), (800, [-1.0] * 12, 5)]
    rows += [(2, None, 1), (None, [1.0] * 12, 1), (3, [1.0, None], 2), (4, [float("nan")] * 12, 2), (5, [float("inf")], 2),
             (6, [1.0] * 12, None)]
    rows += [rows[200], rows[200], (100, [0.7] * 12, 4), (201, [0.9] * 12, 4)]      # an id with two vectors
    rows, df = table(spark, rows)
    got, want = mined(df), brute(rows)
    assert got == want and any(r[4] == 0 for r in want)


def test_empty_table_and_no_partner(spark):
    rows, df = table(spark, [(100, [1.0, 2.0], 3)])
    assert mined(df) == mined(df.where("false")) == []
    rows, df = table(spark, [(100, [1.0], 3), (101, [1.0], 3)])
    assert mined(df) == []                                                         # positives, but nothing else


def test_clashing_columns(spark):
    rows, df = table(spark, vectors(random.Random(3), 250))
    noisy = df.selectExpr("*", "1 AS block", "2 AS anchor", "'x' AS vec", "3 AS rank", "4 AS score", "5 AS highest", "6 AS kind")
    assert mined(noisy) == brute(rows)


def test_index_omits_dimensions_and_prunes():
    rng = np.random.default_rng(4)
    block = M.Block(np.arange(500), np.zeros(500, int), np.floor(rng.normal(size=(500, 32)) * 40))
    anchors = block.aligned(np.floor(rng.normal(size=(20, 32)) * 40))
    norms = M.suffix_norms(anchors)
    scores = anchors @ block.vec.T
    thresholds = np.ceil(np.sort(scores, axis=1)[:, -10])
    index = M.PartialIndex(block, np.arange(500), norms, thresholds)
    assert index.lengths.sum() < 0.9 * 500 * 32                                    # the suffixes are not indexed
    for i, t in enumerate(thresholds):
        rows, found = index.search(anchors[i], norms[i], t)
        assert sorted(rows) == sorted(np.flatnonzero(scores[i] >= t))
        assert (found == scores[i][rows]).all()


def test_too_large_components_raise(spark):
    rows, df = table(spark, [(100, [1e6] * 4, 1), (101, [1e6] * 4, 1)])
    with pytest.raises(Exception, match="exact"):
        mined(df)
