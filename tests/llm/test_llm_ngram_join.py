import random

import numpy as np

from gauntlet.llm import common, ngram_join
from gauntlet.llm.count_rtree import CountRTree, overlap_needed
from gauntlet.llm.graph import components
from llm_helpers import CLASHING, docs, kept_files, prose, words


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, len(sets[a]), least.get(find(a))) for a, (i, _) in enumerate(rows)), key=str)


def near_copies(rng, n, base, changes):
    out = []
    for _ in range(n):
        own = base.split()
        for _ in range(rng.randrange(changes + 1)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10 ** 6)}"
        out.append(" ".join(own))
    return out


def corpus(rng):
    common = prose(rng, 12)
    texts = [prose(rng, rng.randrange(1, 60), 200) for _ in range(60)]
    texts += [common + " " + prose(rng, rng.randrange(1, 30)) for _ in range(60)]
    texts += near_copies(rng, 90, prose(rng, 90), 7) + near_copies(rng, 30, prose(rng, 20), 2) + [prose(rng, 300)] * 25
    texts += near_copies(rng, 12, prose(rng, 2500), 90)
    texts += [None, "", " \t", "One Two", "one two", "one two three", "a " * 500, "a " * 700]
    rng.shuffle(texts)
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


def got(table):
    return sorted((tuple(r) for r in ngram_join.similarity_components(table).collect()), key=str)


def test_components_against_brute_force(spark):
    rows = corpus(random.Random(11))
    rows += [(None, rows[0][1]), (None, None), rows[5], (rows[5][0], "another text of the same id here")]
    assert got(docs(spark, rows, CLASHING)) == brute(rows)


def test_small_shards_give_the_same(spark, monkeypatch):
    rows = corpus(random.Random(12))
    monkeypatch.setattr(ngram_join, "SHARD", 8)
    assert got(docs(spark, rows)) == brute(rows)


def test_a_threshold_met_exactly_links(spark):
    base = [f"a{i}" for i in range(13)]                        # 9 shingles
    longer = base + ["b", "c"]                                 # 11 shingles, 9 shared: 81.8 %
    longest = longer + ["d"]                                   # 12 shingles, 9 shared with base: 75 %
    rows = [(1, " ".join(base)), (2, " ".join(longer)), (3, " ".join(longest)), (4, " ".join(base[:12]))]   # 8 of 9
    five = [(10 + k, " ".join(f"z{i}" for i in range(8 + k))) for k in (0, 1)]                              # 4 of 5: exactly 80 %
    assert got(docs(spark, rows + five)) == brute(rows + five)
    assert dict((r[0], r[2]) for r in brute(rows + five))[11] == 10


def test_one_worker_a_task_and_only_the_result_stays(spark, monkeypatch):
    rows = corpus(random.Random(13)) + [(None, "a text without an id"), (None, None)]
    table = docs(spark, rows)
    tables, shuffles = kept_files(spark)

    pandas_udf = common.F.pandas_udf

    def second(*args, **kwargs):
        assert "functionType" in kwargs, "a pandas UDF takes a worker of its own beside the function over batches"
        return pandas_udf(*args, **kwargs)          # applyInArrow's own call

    monkeypatch.setattr(common.F, "pandas_udf", second)
    out = ngram_join.similarity_components(table)
    after, left = kept_files(spark)
    assert len(after - tables) == 1 and not left - shuffles
    assert got(table) == brute(rows) and out.count() == len(rows)
    assert all(spark.conf.get(key, None) != value for key, value in common.OWN_SETTINGS.items())


def test_empty_table(spark):
    assert ngram_join.similarity_components(docs(spark, [], CLASHING)).count() == 0


def test_tree_finds_every_point_that_the_bound_allows():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 6, (12, 64))
    points = np.maximum(0, centres[rng.integers(0, 12, 900)] + rng.integers(-1, 2, (900, 64))).astype(np.uint32)
    tree, sizes = CountRTree(points), points.sum(axis=1, dtype=np.int64)
    for q in range(0, 900, 37):
        bound = np.minimum(points, points[q]).sum(axis=1, dtype=np.int64)
        want = np.flatnonzero(bound >= overlap_needed(sizes, int(sizes[q]), 80))
        assert sorted(tree.search(points[q], 80)) == want.tolist() and q in want


def test_stars_give_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(190)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    table = spark.createDataFrame(links, "a long, b long")
    rows = components(table).collect()
    assert sorted((r.node, r.component) for r in rows) == sorted((n, find(n)) for n in parent)
    assert components(table.limit(0)).count() == 0
