"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Every rule looks at counts of a whole text and votes 1 (good), 0 (bad) or
abstains.  Expectation-maximisation over the distinct vote patterns (at most
3**rules, counted over all documents) estimates how often each rule casts
each vote on good and on bad texts.  The posterior probability of quality
then replaces all-must-pass filtering.

Cases: a null or empty text has no words, all counts 0 and fails the base
rules.  Repeated rows are judged each; ties (a posterior of exactly the
threshold) are kept.  An empty table gives an empty result.  Only the id and
text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gauntlet.llm.common import batches_of, materialise
from gauntlet.llm.textkernel import Chunk, chunks, span_hashes, window_hashes

#: Frequent function words of the languages served, as written inside a sentence.
FUNCTION_WORDS = ("the of and to in is that it for was de la le les et des un une que los las el en y der die das und "
                  "zu den mit von ist").split()

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct",
          "n_function", "n_upper", "n_letters", "n_marks", "n_open_lines")
SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])


def _table(characters: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(characters)] = True
    return t


SYMBOL, UPPER = _table(b"#*$%&|<>"), _table(bytes(range(65, 91)))
LETTER = _table(bytes([*range(65, 91), *range(97, 123)]))
MARK = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
SENTENCE_END = _table(b".?!:\"')")


def _function_hashes() -> np.ndarray:
    (chunk,) = chunks(pa.array([" ".join(FUNCTION_WORDS)]))
    starts, ends, _ = chunk.words()
    return np.sort(span_hashes(chunk.data, starts, ends))


def text_counts(chunk: Chunk, known: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each row of a chunk; ``known`` are the function words' hashes."""
    data, out = chunk.data, {}
    starts, ends, rows = chunk.words()
    words = span_hashes(data, starts, ends)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out["n_words"] = np.diff(rows)
    out["word_chars"] = chunk.per_row(inside & ((data & 0xC0) != 0x80))
    for name, table in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_letters", LETTER), ("n_marks", MARK)):
        out[name] = chunk.per_row(table[data])
    line_starts, line_ends, line_rows = chunk.runs(data != 10)
    first = np.searchsorted(starts, line_starts)
    filled = first < np.searchsorted(starts, line_ends)             # lines with a word
    last_word = np.searchsorted(starts, line_ends[filled]) - 1
    opened = ~SENTENCE_END[data[ends[last_word] - 1]] if len(ends) else np.zeros(0, bool)
    lines = span_hashes(data, line_starts[filled], line_ends[filled])
    line_rows = np.concatenate([[0], np.cumsum(filled)])[line_rows]
    out["n_lines"] = np.diff(line_rows)
    opened = np.concatenate([[0], np.cumsum(opened)])
    out["n_open_lines"] = opened[line_rows[1:]] - opened[line_rows[:-1]]
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    function = np.concatenate([[0], np.cumsum(known[at] == words)])
    out["n_function"] = function[rows[1:]] - function[rows[:-1]]
    dup, repeat, distinct = (np.zeros(len(chunk), np.int64) for _ in range(3))
    for i in range(len(chunk)):
        own = words[rows[i]:rows[i + 1]]
        dup[i] = line_rows[i + 1] - line_rows[i] - len(np.unique(lines[line_rows[i]:line_rows[i + 1]]))
        distinct[i] = len(np.unique(own))
        _, inverse, n = np.unique(window_hashes(own, 3), return_inverse=True, return_counts=True)
        again = np.flatnonzero(n[inverse] > 1)
        if len(again):
            covered = np.zeros(len(own), dtype=bool)
            for k in range(3):
                covered[again + k] = True
            repeat[i] = covered.sum()
    return out | {"n_dup_lines": dup, "n_repeat_words": repeat, "n_distinct": distinct}


def count_texts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and the counts of COUNTS over its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _function_hashes()
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                ids = batch.column("doc_id").slice(chunk.first, len(chunk))
                counts = text_counts(chunk, known)
                yield from batches_of(pa.table({"doc_id": ids, **{c: counts[c] for c in COUNTS}}), SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)]))


def _vote(bad: Column, good: Column | None = None) -> Column:
    """0 where ``bad``, 1 where ``good``, else null (abstains)."""
    vote = F.when(bad, F.lit(0))
    return vote if good is None else vote.when(good, F.lit(1))


def rule_votes() -> dict[str, Column]:
    """The rules, by name: ratios of counts, so that they hold for texts of any length."""
    c = F.col
    per_word = lambda name: c(name) / F.greatest(c("n_words"), F.lit(1))
    per_line = lambda name: c(name) / F.greatest(c("n_lines"), F.lit(1))
    return {
        "length": _vote(c("n_words") < 20),
        "word_length": _vote((per_word("word_chars") < 2.5) | (per_word("word_chars") > 14)),
        "symbols": _vote(per_word("n_symbols") > 0.1, per_word("n_symbols") < 0.005),
        "marks": _vote(per_word("n_marks") > 0.6, per_word("n_marks") < 0.3),
        "capitals": _vote(c("n_upper") > 0.4 * c("n_letters"), c("n_upper") < 0.15 * c("n_letters")),
        "function_words": _vote(per_word("n_function") < 0.03, per_word("n_function") > 0.1),
        "repeats": _vote(per_word("n_repeat_words") > 0.3, per_word("n_repeat_words") < 0.1),
        "vocabulary": _vote(c("n_distinct") < 0.3 * c("n_words")),
        "duplicate_lines": _vote(per_line("n_dup_lines") > 0.3),
        "open_lines": _vote((c("n_lines") > 3) & (per_line("n_open_lines") > 0.5), per_line("n_open_lines") < 0.2),
    }


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, *, prior: float = 0.8, accuracy: float = 0.8,
                    rounds: int = 100, smoothing: float = 1.0) -> np.ndarray:
    """Posterior of quality for each vote pattern (rows; -1 abstains), by expectation-maximisation.

    Given the class, rules are independent; each has its own probability of
    voting good, bad or abstaining.  Starting from rules that are right with
    ``accuracy`` fixes which class is the good one.
    """
    if not len(patterns):
        return np.zeros(0)
    votes = np.stack([patterns == v for v in (0, 1, -1)], axis=2).astype(float)     # pattern, rule, vote
    counts = counts.astype(float)
    odds = np.log(accuracy / (1 - accuracy))
    score = np.log(prior / (1 - prior)) + odds * (votes[:, :, 1] - votes[:, :, 0]).sum(axis=1)
    posterior = 1 / (1 + np.exp(-score))
    for _ in range(rounds):
        logs = []
        for weight in (posterior * counts, (1 - posterior) * counts):
            seen = np.einsum("p,prv->rv", weight, votes) + smoothing
            logs.append(np.log(seen / seen.sum(axis=1, keepdims=True)))
        share = (np.dot(posterior, counts) + smoothing) / (counts.sum() + 2 * smoothing)
        score = np.log(share / (1 - share)) + np.einsum("rv,prv->p", logs[0] - logs[1], votes)
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        if np.abs(new - posterior).max() < 1e-9:
            return new
        posterior = new
    return posterior


def judge_quality(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """One row per document: counts, base_failed, posterior quality and kept."""
    rules = rule_votes()
    code = sum((F.coalesce(v, F.lit(2)) * 3 ** i for i, v in enumerate(rules.values())), F.lit(0)).cast("int")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = materialise(count_texts(docs).withColumn("pattern", code).withColumn("base_failed", base), "quality-rules")
    seen = judged.groupBy("pattern").count().toPandas().sort_values("pattern")        # 3**rules rows at most
    digits = seen["pattern"].to_numpy()[:, None] // 3 ** np.arange(len(rules)) % 3
    quality = fit_label_model(np.where(digits == 2, -1, digits), seen["count"].to_numpy())
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(seen["pattern"].tolist(), quality.tolist())))

    @F.pandas_udf("double")
    def posterior(patterns: pd.Series) -> pd.Series:
        return patterns.map(known.value)

    judged = judged.withColumn("quality", posterior("pattern"))
    kept = ~F.col("base_failed") & (F.col("quality") >= threshold)
    return judged.select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), "quality", *COUNTS[5:])
