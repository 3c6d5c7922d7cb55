import numpy as np

from gauntlet.llm import language_id as li
from gauntlet.llm.common import read_table
from llm_helpers import CLASHING, docs


def test_forward_sums_all_segmentations():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"abc", b"bc", b" ab"})
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces) + 1, 2))
    p[-1] = 0
    model = li.PieceModel(pieces, ["x", "y"], p / p.sum(axis=0))

    def brute(word, lang):
        if not word:
            return 1.0
        return sum(model.probability[pieces.index(word[:k]), lang] * brute(word[k:], lang)
                   for k in range(1, len(word) + 1) if word[:k] in pieces)

    for word in ("abcab", "é", "a", "bcabc"):
        got = model.log_scores([word])[0]
        assert np.allclose(got, [np.log(brute((" " + word).encode(), lang)) for lang in (0, 1)])


def whole(model, word):
    """Log forward sum of a run and expected pieces of its first language, in plain logarithms over the whole run."""
    raw, number = (" " + word).encode(), {p: k for k, p in enumerate(model.pieces)}
    arcs = [(i, j, number[raw[i:j]]) for j in range(1, len(raw) + 1) for i in range(max(0, j - 40), j) if raw[i:j] in number]
    log_p = np.log(model.probability[:-1])
    alpha, beta = np.full((len(raw) + 1, log_p.shape[1]), -np.inf), np.full(len(raw) + 1, -np.inf)
    alpha[0], beta[-1], expected = 0, 0, np.zeros(len(model.pieces))
    for i, j, k in arcs:
        alpha[j] = np.logaddexp(alpha[j], alpha[i] + log_p[k])
    for i, j, k in reversed(arcs):
        beta[i] = np.logaddexp(beta[i], beta[j] + log_p[k, 0])
        expected[k] += np.exp(alpha[i, 0] + log_p[k, 0] + beta[j] - alpha[-1, 0])
    return alpha[-1], expected


def test_long_runs_are_summed_over_window_edges():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"abc", b"bc", b" ab", b"abcabcabcabcabc"})
    rng = np.random.default_rng(2)
    p = rng.random((len(pieces) + 1, 2)) + 1e-9
    p[-1] = 0
    model = li.PieceModel(pieces, ["x", "y"], p / p.sum(axis=0))
    for word in ("abc" * 16, "abc" * 40, "é" * 33 + "abcab" * 30, "ab" * 700):
        score, expected = whole(model, word)
        raw, log_p = li._marked(word), np.log(model.probability[:-1])
        assert np.allclose(model.log_scores([word])[0], score)
        for window in (7, 50, 1 << 16):
            assert np.allclose(list(model.walk(raw, log_p, window))[-1][-1], score)
            assert np.allclose(model.expected_pieces(raw, log_p[:, :1], window), expected)
    assert np.isfinite(model.log_scores(["ab" * 40000])).all()


def test_every_usable_piece_is_kept():
    pieces = li.vocabulary(li.MODEL_PATH)
    usable = [p.piece for p in li.parse_model(li.MODEL_PATH).pieces if p.type == li.NORMAL and p.piece.removeprefix(li.MARKER).isalpha()
              and p.piece.islower()]
    assert max(map(len, pieces)) > 10 and {p.replace(li.MARKER, " ").encode() for p in usable} <= set(pieces)


def test_fitting_counts_long_runs():
    pieces = li.vocabulary(li.MODEL_PATH)
    model = li.PieceModel(pieces, ["de", "en"])
    model.fit([{"donau" * 30: 5, "haus": 1}, {"house": 1}], rounds=2)
    assert np.allclose(model.probability.sum(axis=0), 1)
    de, en = model.log_scores(["donau" * 30])[0]
    assert de > en


def test_fitting_raises_the_likelihood():
    pieces = li.vocabulary(li.MODEL_PATH)
    counts = [{"haus": 5, "häuser": 3, "maus": 4}, {"house": 5, "mouse": 4}]
    totals = []
    for rounds in (1, 2, 4):
        model = li.PieceModel(pieces, ["de", "en"])
        model.fit(counts, rounds=rounds, smoothing=1e-9)
        assert np.allclose(model.probability.sum(axis=0), 1)
        totals.append(sum(n * model.log_scores([w])[0, 0] for w, n in counts[0].items()))
    assert totals[0] <= totals[1] + 1e-6 <= totals[2] + 2e-6


def test_held_out_accuracy(spark):
    table = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = li.identify(table).join(table.select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() > 0.98


def test_edge_cases(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the mouse", "en"), ("das haus und die maus", "de")] * 8)]
    extra = [(50, None, "en"), (51, "", None), (52, "123 !!! ——", None), (53, "Das HAUS", None), (54, "haus " * 40000, None), (54, "mouse", None),
             (None, "the mouse", None)]
    got = li.identify(docs(spark, rows + extra, CLASHING)).collect()
    assert len(got) == len(rows) + len(extra)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (50, 51, 52))
    assert sorted(r.lang_pred for r in got if r.doc_id == 54) == ["de", "en"]
    assert {r.lang_pred for r in got if r.doc_id == 53} == {"de"} and all(0 <= r.score <= 1 for r in got)
    nothing = li.identify(docs(spark, [(1, "the house")], CLASHING)).collect()
    assert nothing[0].lang_pred == "und" and li.identify(docs(spark, [], CLASHING)).count() == 0
