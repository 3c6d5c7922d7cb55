import math
import random
import zlib
from collections import Counter

import pytest

from gauntlet.llm import lm_scoring
from gauntlet.llm.lm_scoring import score_documents
from llm_helpers import CLASHING, docs, prose, words


def brute(rows, order, strength):
    """Base score and interpolated n-gram score of each row, straight from the definition."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    tokens = [[*words(t), " end"] for _, t in rows]
    pad = [" begin"] * (order - 1)
    seen, context = Counter(), Counter()
    for own, out in zip(tokens, held):
        if not out:
            padded = pad + own
            for i in range(len(pad), len(padded)):
                for m in range(1, order + 1):
                    seen[tuple(padded[i - m + 1:i + 1])] += 1
                    context[tuple(padded[i - m + 1:i])] += 1
    n, v = sum(c for g, c in seen.items() if len(g) == 1), sum(len(g) == 1 for g in seen)
    out = []
    for (i, _), own, is_held in zip(rows, tokens, held):
        padded, base, score = pad + own, 0.0, 0.0
        for k in range(len(pad), len(padded)):
            p = (seen[padded[k],] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for m in range(2, order + 1):
                gram = tuple(padded[k - m + 1:k + 1])
                p = (seen[gram] + strength * p) / (context[gram[:-1]] + strength)
            score += math.log10(p)
        out.append((i, is_held, len(own), sum(seen[w,] > 0 for w in own), n, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 5))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]], abs=1e-6)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force_over_many_blocks(spark, order):
    rng = random.Random(order)
    rows = [(i, prose(rng, rng.randrange(60), 40)) for i in range(120)] + [(1000, None), (1001, ""), (1002, " \n"), (None, "W1 w2"),
                                                                          (3, "w1 w2 w3"), (1003, "w1 W2 é " * 4000)]
    got = score_documents(docs(spark, rows, CLASHING), order=order, strength=2.0, block_bytes=3000).collect()
    same(got, brute(rows, order, 2.0))


def test_probabilities_of_a_context_sum_to_one(spark):
    rows = [(2, "a b a c"), (3, "a b")]             # neither is held out
    one = brute(rows + [(30, "a " + w) for w in ()], 2, 5.0)
    same(score_documents(docs(spark, rows)).collect(), one)
    vocabulary = ["a", "b", "c", " end", "unseen"]
    seen, context, n = Counter({("a", "b"): 2, ("a", "c"): 1, ("b", "a"): 1, ("b", " end"): 1, ("c", " end"): 1}), 3, 8
    unigram = {"a": 3, "b": 2, "c": 1, " end": 2, "unseen": 0}
    total = sum((seen["a", w] + 5 * (unigram[w] + 0.1) / (n + 0.1 * 5)) / (context + 5) for w in vocabulary)
    assert total == pytest.approx(1)


def test_equal_rows_are_spread_over_blocks(spark):
    rows = [(None, "a b c a b")] * 300 + [(7, "a b d")] * 300
    got = score_documents(docs(spark, rows), block_bytes=400).collect()
    same(got, brute(rows, 2, 5.0))
    texts = lm_scoring.dealt(docs(spark, rows), 8, 10).groupBy("block").count().collect()
    assert len(texts) == 8 and max(r["count"] for r in texts) < 200


def test_empty_table_and_no_training_text(spark):
    assert score_documents(docs(spark, [], CLASHING)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = score_documents(docs(spark, [(held, "a b")])).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
