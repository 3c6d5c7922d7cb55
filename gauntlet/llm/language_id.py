"""Language identification by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary: those made of lower-case letters,
with or without the word marker, and all single bytes.  Every language has
its own piece probabilities, estimated by expectation-maximisation.  A word's
probability is the sum over all its segmentations into pieces, computed by a
forward algorithm; a text's is the product over its words.

Words are lower-cased runs of letters, of any length.  Runs of up to
``BATCHED_BYTES`` bytes go through the forward algorithm together, by length;
longer ones alone, in windows that hand the forward sums on, so segmentations
over a window's edge count like all others.  The model is fitted on a bounded
sample: ``docs_per_language`` ids of each language by hash, with their whole
texts.  The driver gets the sample's distinct words with their counts, at most
as many bytes as the sample's distinct texts have.

Cases: a null text or one without a letter is ``und`` with score 0, and so is
every text when there is nothing to learn from; equal scores go to the
language first in the alphabet.  Repeated rows are judged each.  Only the
named columns are read, so other columns cannot clash.  An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gauntlet.llm.common import held_out, lean
from gauntlet.llm.sentencepiece_codec import MARKER, MODEL_PATH, NORMAL, parse_model
from gauntlet.llm.textkernel import mix

DOCS_PER_LANGUAGE = 250
BATCHED_BYTES = 48
WINDOW_BYTES = 1 << 16            # of a long run, whose pieces are looked up at once
CACHE_WORDS = 100_000
BATCH_CHARS = 2 << 20
START = 1e250                     # of the forward sums, which fall below the least double else
UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def vocabulary(path: str) -> list[bytes]:
    """The pieces: letters of the public vocabulary in lower case (space for the marker), and all bytes."""
    found = {bytes([b]) for b in range(256)}
    for piece in parse_model(path).pieces:
        body = piece.piece.removeprefix(MARKER)
        if piece.type == NORMAL and (body == "" or (LETTERS.fullmatch(body) and body == body.lower())):
            found.add(piece.piece.replace(MARKER, " ").encode())
    return sorted(found)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def _marked(word: str) -> bytes:
    return (" " + word).encode()


def _substring_keys(matrix: np.ndarray) -> np.ndarray:
    """Prefix sums from which any substring's key follows; one row per word."""
    n, length = matrix.shape
    power = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(length, _BASE))])
    sums = np.zeros((length + 1, n), np.uint64)
    np.cumsum((matrix.T.astype(np.uint64) + np.uint64(1)) * power[:length, None], axis=0, out=sums[1:])
    return sums


def _key(sums: np.ndarray, i: int, j: int) -> np.ndarray:
    back = np.uint64(pow(int(_INVERSE), i, 1 << 64))
    return _with_length((sums[j] - sums[i]) * back, j - i)


def _with_length(key: np.ndarray, length: int) -> np.ndarray:
    return mix(key + np.uint64(length * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))


@dataclass
class PieceModel:
    """Piece probabilities by language over a fixed vocabulary."""

    pieces: list[bytes]
    languages: list[str]
    probability: np.ndarray = None                 # piece (and one of probability 0), language
    keys: np.ndarray = field(init=False)
    order: np.ndarray = field(init=False)
    lengths: list[int] = field(init=False)         # in bytes, of the pieces; ascending

    def __post_init__(self):
        self.lengths = sorted({len(p) for p in self.pieces})
        self.keys = np.empty(len(self.pieces), np.uint64)
        for length, own in pd.Series(range(len(self.pieces))).groupby([len(p) for p in self.pieces]):
            raw = np.frombuffer(b"".join(self.pieces[i] for i in own), np.uint8).reshape(-1, length)
            self.keys[own.to_numpy()] = _key(_substring_keys(raw), 0, length)
        self.order = np.argsort(self.keys)
        self.keys = self.keys[self.order]
        if self.probability is None:
            self.probability = np.zeros((len(self.pieces) + 1, len(self.languages)))
            self.probability[:-1] = 1 / len(self.pieces)

    def numbers(self, key: np.ndarray) -> np.ndarray:
        """Piece number of each key; the last number is none."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], len(self.pieces))

    def lattice(self, words: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
        """Piece number of each substring (start, end) of words of one length, by ascending ends."""
        length = len(words[0])
        sums = _substring_keys(np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length))
        return {(j - size, j): self.numbers(_key(sums, j - size, j))
                for j in range(1, length + 1) for size in self.lengths if size <= j}

    def hits(self, raw: bytes, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and number of every piece that ends in lo + 1 to hi, by ends; and where each end's begin."""
        before = max(0, lo - self.lengths[-1])
        sums = _substring_keys(np.frombuffer(raw, np.uint8, hi - before, before)[None])[:, 0]
        back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(hi - before, _INVERSE)]))
        starts, ends, pieces = [], [], []
        for size in self.lengths:
            at = np.arange(max(0, lo + 1 - size - before), hi - before - size + 1)
            piece = self.numbers(_with_length((sums[at + size] - sums[at]) * back[at], size))
            found = piece < len(self.pieces)
            starts.append(at[found] + before)
            ends.append(at[found] + before + size)
            pieces.append(piece[found])
        by = np.argsort(np.concatenate(ends), kind="stable")
        start, end, piece = (np.concatenate(x)[by] for x in (starts, ends, pieces))
        return start, end, piece, np.searchsorted(end, np.arange(lo + 1, hi + 2))

    def walk(self, raw: bytes, log_p: np.ndarray, window: int = WINDOW_BYTES) -> Iterator[np.ndarray]:
        """Log forward sums of a long run at its positions from 1, window by window; each row has the languages."""
        tail, langs = np.zeros((1, log_p.shape[1])), log_p.shape[1]
        for lo in range(0, len(raw), window):
            hi = min(len(raw), lo + window)
            start, _, piece, cut = self.hits(raw, lo, hi)
            zero = lo + 1 - len(tail)                       # the position in the first row
            sums = np.concatenate([tail, np.empty((hi - lo, langs))])
            gain, at = log_p[piece], start - zero
            for row, a, b in zip(range(len(tail), len(sums)), cut[:-1].tolist(), cut[1:].tolist()):
                sums[row] = np.logaddexp.reduce(sums[at[a:b]] + gain[a:b], axis=0)
            yield sums[len(tail):]
            tail = sums[-self.lengths[-1]:]

    def forward(self, lattice: dict, length: int, n: int, p: np.ndarray) -> np.ndarray:
        """START times the summed probability of all segmentations of each prefix: position, word, language."""
        alpha = np.zeros((length + 1, n, p.shape[1]))
        alpha[0] = START
        for (i, j), piece in lattice.items():
            if (piece < len(self.pieces)).any():
                alpha[j] += alpha[i] * p[piece]
        return alpha

    def log_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        raw, out = [_marked(w) for w in words], np.zeros((len(words), len(self.languages)))
        sizes = np.array([len(r) for r in raw])
        for length in np.unique(sizes[sizes <= BATCHED_BYTES]):
            at = np.flatnonzero(sizes == length)
            for k in range(0, len(at), 4096):
                part = at[k:k + 4096]
                lattice = self.lattice([raw[w] for w in part])
                out[part] = np.log(self.forward(lattice, length, len(part), self.probability)[length]) - np.log(START)
        long = np.flatnonzero(sizes > BATCHED_BYTES)
        if len(long):
            log_p = np.log(self.probability[:-1])
            for w in long:
                for sums in self.walk(raw[w], log_p):
                    out[w] = sums[-1]
        return out

    def fit(self, counts: list[dict[str, int]], *, rounds: int = 4, smoothing: float = 0.02) -> None:
        """Expectation-maximisation of each language's probabilities from its word counts."""
        for own, words in enumerate(counts):
            grouped: dict[int, list[tuple[bytes, int]]] = {}
            long: list[tuple[bytes, int]] = []
            for word, n in sorted(words.items()):
                raw = _marked(word)
                (grouped.setdefault(len(raw), []) if len(raw) <= BATCHED_BYTES else long).append((raw, n))
            ready = [(length, self.lattice([b for b, _ in rows]), np.array([n for _, n in rows], float)[:, None])
                     for length, rows in grouped.items()]
            p = self.probability[:, own:own + 1].copy()
            for _ in range(rounds):
                expected = np.zeros(len(p))
                for length, lattice, n in ready:
                    alpha = self.forward(lattice, length, len(n), p)
                    beta = np.zeros_like(alpha)
                    beta[length] = n / alpha[length]
                    for (i, j), piece in sorted(lattice.items(), key=lambda x: -x[0][1]):
                        share = beta[j] * p[piece]
                        beta[i] += share
                        expected += np.bincount(piece, (alpha[i] * share)[:, 0], len(p))
                for raw, n in long:
                    expected[:-1] += n * self.expected_pieces(raw, np.log(p[:-1]))
                p[:-1, 0] = (expected[:-1] + smoothing) / (expected[:-1] + smoothing).sum()
            self.probability[:, own] = p[:, 0]

    def expected_pieces(self, raw: bytes, log_p: np.ndarray, window: int = WINDOW_BYTES) -> np.ndarray:
        """How often each piece occurs in a long run, over all its segmentations; of one language (column)."""
        alpha = np.concatenate([[0.0], *(sums[:, 0] for sums in self.walk(raw, log_p, window))])
        beta, out = np.full(len(raw) + 1, -np.inf), np.zeros(len(log_p))
        beta[-1] = 0
        for lo in reversed(range(0, len(raw), window)):
            hi = min(len(raw), lo + window)
            start, end, piece, cut = self.hits(raw, lo, hi)
            gain = log_p[piece, 0]
            for j in range(hi, lo, -1):
                s = slice(cut[j - lo - 1], cut[j - lo])
                beta[start[s]] = np.logaddexp(beta[start[s]], beta[j] + gain[s])
            out += np.bincount(piece, np.exp(alpha[start] + gain + beta[end] - alpha[-1]), len(out))
        return out


def fit_model(docs: DataFrame, *, model_path: str, docs_per_language: int) -> PieceModel:
    """Fit on a bounded sample; word counts are gathered by Spark."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.col("lang").cast("string").alias("lang"))
    usable = usable.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id", 4, 2))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = usable.select("doc_id", "lang").withColumn("rank", F.row_number().over(by_hash))
    ids = ids.where(F.col("rank") <= docs_per_language).select("doc_id", "lang").distinct()
    sample = usable.join(F.broadcast(ids), ["doc_id", "lang"])      # docs_per_language ids of a language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, word, n) for lang, own in found.items() for word, n in own.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "word", "n"])

    counted = sample.select("lang", "text").mapInArrow(lean(run), "lang string, word string, n long")
    rows = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    model = PieceModel(vocabulary(model_path), languages)
    model.fit([dict(zip(own["word"], own["n"])) for own in (rows[rows["lang"] == lang] for lang in languages)])
    return model


class _Scorer:
    """Scores texts in a worker; word scores are kept, CACHE_WORDS at most besides a batch's own."""

    def __init__(self, model: PieceModel):
        self.model, self.index = model, {}
        self.scores = np.zeros((0, len(model.languages)))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lists = [words_of(t) if t else [] for t in texts]
        sizes = np.array([len(x) for x in lists])
        codes, distinct = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
        if len(self.index) > CACHE_WORDS:
            self.index, self.scores = {}, self.scores[:0]
        new = [w for w in distinct if w not in self.index]
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.scores = np.concatenate([self.scores, self.model.log_scores(new)])
        rows = np.array([self.index[w] for w in distinct], np.int64)
        langs, best = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        filled = np.flatnonzero(sizes)
        if len(filled) and self.model.languages:
            first = (np.cumsum(sizes) - sizes)[filled]
            total = np.add.reduceat(self.scores[rows[codes]], first, axis=0)
            odds = np.exp(total - total.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            for r, own in zip(filled, odds):
                langs[r], best[r] = self.model.languages[int(own.argmax())], own.max()
        return langs, best


def identify(docs: DataFrame, *, model_path: str = MODEL_PATH, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred and score (posterior of lang_pred)."""
    model = docs.sparkSession.sparkContext.broadcast(
        fit_model(docs, model_path=model_path, docs_per_language=docs_per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or _Scorer(model.value)
            texts = batch.column("text").to_pylist()
            langs, scores, i = [], [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < BATCH_CHARS):
                    size += len(texts[j] or "")
                    j += 1
                own, best = scorer(texts[i:j])
                langs += own
                scores.append(best)
                i = j
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()),
                 pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lean(run), "doc_id long, lang_pred string, score double").select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
