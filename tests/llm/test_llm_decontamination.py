import random

import numpy as np

from gauntlet.llm import decontamination as dc
from llm_helpers import CLASHING, docs, prose, words

ITEMS = "item_id long, text string, doc_id long, tiles string"


def items(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], ITEMS)


def tile_brute(doc, item, least):
    """Greedy string tiling by definition: mark a longest free common run (leftmost), until none is long enough."""
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    least = min(least, len(item))
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and free_d[d + n] and free_i[i + n] and doc[d + n] == item[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if not n or n < least:
            return tiles
        tiles.append((d, i, n))
        for k in range(n):
            free_d[d + k] = free_i[i + k] = False


def test_tiles_against_brute_force():
    rng = random.Random(8)
    for _ in range(250):
        doc = [rng.randrange(6) for _ in range(rng.randrange(40))]
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 14))]
        if rng.random() < 0.5 and len(doc) > 12:
            item = doc[3:9] + item + doc[9:12]
        got = dc.greedy_tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        want = tile_brute(doc, item, 3)
        assert sorted(n for *_, n in got) == sorted(n for *_, n in want), (doc, item, got, want)
        for d, i, n in got:
            assert doc[d:d + n] == item[i:i + n]


def test_reordered_passages_are_caught_and_clean_documents_left(spark):
    rng = random.Random(9)
    tests = {i: prose(rng, 40) for i in range(12)}
    rows, bad = [], set()
    for i in range(60):
        own, item = prose(rng, 60).split(), tests[i % 12].split()
        kind = i % 5
        if kind == 0:
            own[30:30] = item
        elif kind == 1:
            parts = [item[k:k + 10] for k in range(0, 40, 10)]
            rng.shuffle(parts)
            own[20:20] = sum(([*p, "gap"] for p in parts), [])
        elif kind == 2:
            own[10:10] = [w.upper() for w in item[5:35]]
        elif kind == 3:
            own[10:10] = item[:15]                              # too little of the item
        rows.append((i, " ".join(own)))
        if kind < 3:
            bad.add((i, i % 12))
    rows += [(100, None), (101, ""), (102, prose(rng, 30000) + " " + tests[3]), (0, rows[0][1]), (103, "yes it is so no")]
    bench = [*tests.items(), (20, None), (21, ""), (22, "it is"), (23, tests[3]), (None, tests[4])]
    found = dc.contaminated_pairs(docs(spark, rows, CLASHING), items(spark, bench)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == bad | {(102, 3), (103, 22)}
    assert sum(r.doc_id == 0 for r in found) == 2               # a repeated row is judged each time
    text = {i: words(t) for i, t in rows}
    for r in found:
        want = words(dict(bench)[r.item_id])
        assert r.item_tokens == len(want) and r.covered == sum(t["words"] for t in r.tiles) and r.coverage >= 0.5
        for t in r.tiles:
            assert text[r.doc_id][t.doc_start:t.doc_start + t["words"]] == want[t.item_start:t.item_start + t["words"]]
    table = docs(spark, rows, CLASHING)
    kept = dc.decontaminate(table, items(spark, bench))
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {d for d, _ in bad} - {102, 103}


def test_items_with_repeated_phrases_are_caught(spark):
    rng = random.Random(23)
    tests = {0: "a b c d " * 12, 1: " ".join(f"p{i % 9}" for i in range(100)), 2: "no " * 20, 3: prose(rng, 30) + " la la di " * 10,
             4: " ".join(f"{i % 3} {i % 2}" for i in range(60)), 5: "one two three four five six " * 2}
    rows = [(i, prose(rng, 40) + " " + t.upper() + " " + prose(rng, 40)) for i, t in tests.items()]
    rows += [(100 + i, prose(rng, 40) + " " + " ".join(words(t)[:len(words(t)) // 3]) + " " + prose(rng, 40)) for i, t in tests.items()]
    found = {(r.doc_id, r.item_id) for r in dc.contaminated_pairs(docs(spark, rows), items(spark, tests.items())).collect()}
    want = {(d, i) for d, t in rows for i, item in tests.items()
            if sum(n for *_, n in tile_brute(words(t), words(item), 5)) >= 0.5 * len(words(item))}
    assert found == want and {(i, i) for i in tests} <= found


def test_empty_tables(spark):
    table, bench = docs(spark, [(1, "a b c d e f g h")]), items(spark, [(1, "a b c d e f g h")])
    assert dc.contaminated_pairs(table, bench).count() == 1
    assert dc.contaminated_pairs(table.limit(0), bench).count() == 0
    assert dc.contaminated_pairs(table, bench.limit(0)).count() == 0 and dc.decontaminate(table, bench.limit(0)).count() == 1
