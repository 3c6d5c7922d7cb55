import random
import zlib
from collections import Counter

import numpy as np

from gauntlet.llm import quality_classifier, quality_rules
from gauntlet.llm.common import read_table
from llm_helpers import CLASHING, docs, prose, words


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    scored = quality_classifier.score_documents(read_table(spark, d, "documents"), read_table(spark, d, "labels"))
    rows = scored.join(read_table(spark, d, "labels"), "doc_id").toPandas()
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all()
    held = rows[rows["held_out"]]
    assert len(held) > 50 and ((held["score"] >= 0.5) == (held["quality"] == 1)).mean() > 0.95


def test_classifier_edge_cases(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 40) if i % 2 else "# # # # " * 20) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "one " * 30000), (None, "text"), (1, rows[1][1])]
    table = docs(spark, rows, CLASHING)
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(40)] + [(1, 1, 0, "x"), (7, None, 0, "x"), (None, 1, 0, "x"), (8, 5, 0, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    got = quality_classifier.score_documents(table, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[100].score == by[101].score and by[1].score > by[2].score and by[None].held_out is False
    none = quality_classifier.score_documents(table, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    assert quality_classifier.score_documents(table.limit(0), labels).count() == 0


def test_training_sample_is_bounded_in_rows_and_bytes(spark):
    rng = random.Random(6)
    texts = [prose(rng, 30) for _ in range(50)]
    rows = [(1, texts[i % 25]) for i in range(2000)] + [(2, texts[25 + i % 25]) for i in range(2000)] + [(3, None), (3, "x y z")]
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    usable = {i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 4 != 2}
    bags = [quality_classifier.training_bags(docs(spark, rows).repartition(n), labels, 10).toPandas().sort_values("doc_id")
            for n in (1, 7)]
    assert [set(b["doc_id"]) for b in bags] == [usable] * 2 and all(len(b) == len(usable) for b in bags)
    for column in ("ids", "shares"):
        assert all((x == y).all() for x, y in zip(*(b[column] for b in bags)))
    many = [(i, "w " * 500) for i in range(60)]
    held = spark.createDataFrame([(i, 0) for i in range(60)], "doc_id long, quality int")
    few = quality_classifier.training_bags(docs(spark, many), held, 40, max_bytes=10_000).count()
    assert few == 10 and quality_classifier.training_bags(docs(spark, many), held, 40, max_bytes=1).count() == 1


def test_training_is_gradient_descent(spark):
    """Two passes over three bags against the same steps on dense arrays."""
    bags = [(np.array([1, 5]), np.array([0.25, 0.75], np.float32)), (np.array([5, 9]), np.array([0.5, 0.5], np.float32)),
            (np.array([2]), np.array([1.0], np.float32))]
    labels, dim, batch, rate, seed = np.array([0, 1, 1]), 4, 2, 2.0, 3
    model = quality_classifier.train(bags, labels, dim=dim, epochs=2, least_steps=1, rate=rate, batch=batch, seed=seed)
    rng, size = np.random.default_rng(seed), quality_classifier.KINDS * quality_classifier.BUCKETS
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32).astype(float)
    x = np.zeros((3, size))
    for row, (ids, shares) in zip(x, bags):
        row[ids] = shares
    layer, bias, step = np.zeros((dim, 2)), np.zeros(2), 0
    for _ in range(2):
        order = rng.permutation(3)
        for own in (order[:2], order[2:]):
            now = rate * (1 - step / 4)
            step += 1
            mean = x[own] @ vectors
            odds = np.exp(mean @ layer + bias)
            error = odds / odds.sum(axis=1, keepdims=True) - np.eye(2)[labels[own]]
            to_vectors, to_layer = x[own].T @ (error @ layer.T), mean.T @ error / len(own)
            vectors, layer, bias = vectors - now * to_vectors, layer - now * to_layer, bias - now * error.mean(axis=0)
    assert np.allclose(model.weights, vectors @ (layer[:, 1] - layer[:, 0]), atol=1e-5)
    assert np.isclose(model.bias, bias[1] - bias[0], atol=1e-5)


def brute_counts(text):
    own, text = words(text, lower=False), text or ""
    lines = [x for x in text.split("\n") if words(x, lower=False)]
    windows = Counter(tuple(own[i:i + 3]) for i in range(len(own) - 2))
    covered = {i + k for i in range(len(own) - 2) if windows[tuple(own[i:i + 3])] > 1 for k in range(3)}
    return (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_rule_counts_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab é#|\n\t<") for _ in range(rng.randrange(80)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "a b c " * 20000), (903, "\n\nx\nx \nx\n"), (904, prose(rng, 200)), (904, prose(rng, 60))]
    got = quality_rules.judge_quality(docs(spark, rows, CLASHING)).collect()
    key = lambda r: (r[0], r[1:6])
    want = sorted((i, brute_counts(t)) for i, t in rows)
    assert sorted((r.doc_id, tuple(r)[1:6]) for r in got) == want, key
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5) and 0 <= r.quality <= 1
    assert quality_rules.judge_quality(docs(spark, [], CLASHING)).count() == 0


def test_label_model_finds_accurate_rules():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.75, 0.6])
    votes = np.where(rng.random((4000, 5)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((4000, 5)) < 0.3] = -1
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior = quality_rules.fit_label_model(patterns, counts)[at.ravel()]
    assert ((posterior >= 0.5) == truth).mean() > 0.93
    one = quality_rules.fit_label_model(np.array([[1, -1], [-1, -1]]), np.array([5, 5]))
    assert one[0] >= one[1] and not len(quality_rules.fit_label_model(np.zeros((0, 2)), np.zeros(0)))
