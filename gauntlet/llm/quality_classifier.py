"""Quality classifier: supervised subword embeddings, averaged per document, softmax output.

Words, word pairs and character n-grams (bytes, whole text, case kept) are
hashed into buckets; pairs of the same word share one bucket, so that
repetition is learned from any word.  Each bucket has a learned vector; a
document is the mean of its features' vectors, every kind of feature weighing
the same, and a linear layer with softmax gives the label.  Training
is stochastic gradient descent in numpy over a bounded sample of labelled
rows: ``max_per_class`` documents of either label, by hash of the id, whole
texts, and of these the first whose texts come to ``max_bytes``.  Scoring runs over all documents; since the layer is linear, each
bucket's share of the logit is one number, and that table is broadcast
(``KINDS * BUCKETS`` floats).

Cases: null and empty texts have no feature and get the score of the bias;
labels that are null or not 0/1 are ignored; a document with both labels
counts for both; of rows that repeat a sampled id the one whose text has the
least hash is learned from.  Without labels of both classes the score is the share of
label 1 (0.5 without any).  Repeated rows are scored each.  Only the named
columns are read, so other columns cannot clash.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gauntlet.llm.common import held_out
from gauntlet.llm.textkernel import Chunk, chunks, span_hashes, window_hashes

BUCKETS = 1 << 16      # of each kind of feature
NGRAMS = (3, 4)        # bytes
KINDS = 2 + len(NGRAMS)
MAX_PER_CLASS = 1500
MAX_SAMPLE_BYTES = 128 << 20   # of the texts of either label
_K = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)


def _ngram_ids(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte."""
    m = max(0, len(data) - n + 1)
    h = np.full(m, n, np.uint32)
    for k in range(n):
        h = (h ^ data[k:k + m]) * _K[k]
    return (h ^ (h >> np.uint32(15))) * _K[4] >> np.uint32(16) & np.uint32(BUCKETS - 1)


def features(chunk: Chunk) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature: bucket ids, and where each row's ids begin and end."""
    starts, ends, rows = chunk.words()
    words, last = span_hashes(chunk.data, starts, ends), np.uint64(BUCKETS - 1)
    pairs = np.where(words[1:] == words[:-1], 0, window_hashes(words, 2) & last).astype(np.int64) + BUCKETS
    first = np.minimum(rows[:-1], len(pairs))
    out = [((words & last).astype(np.int64), rows[:-1], rows[1:]), (pairs, first, np.maximum(first, rows[1:] - 1))]
    for kind, n in enumerate(NGRAMS, 2):
        ids = _ngram_ids(chunk.data, n).astype(np.int64) + kind * BUCKETS
        first = np.minimum(chunk.offsets[:-1], len(ids))
        out.append((ids, first, np.maximum(first, np.minimum(chunk.offsets[1:] - n + 1, len(ids)))))
    return out


@dataclass
class Model:
    """Share of the logit of label 1 per bucket, and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, chunk: Chunk) -> np.ndarray:
        total = np.zeros(len(chunk))
        for ids, first, last in features(chunk):
            sums = np.zeros(len(ids) + 1)
            np.cumsum(self.weights[ids], out=sums[1:])
            total += (sums[last] - sums[first]) / np.maximum(last - first, 1) / KINDS
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, dim: int = 16, epochs: int = 12,
          least_steps: int = 1500, rate: float = 2.0, batch: int = 16, seed: int = 1) -> Model:
    """Fit by stochastic gradient descent; a bag is (distinct bucket ids, the share of each).

    A step moves the layer by the mean gradient of its batch, and the vectors
    by the sum: most buckets are in one document of a batch, and would else
    hardly move.
    """
    weights = np.zeros(KINDS * BUCKETS)
    if len(set(labels.tolist())) < 2:
        share = float(np.mean(labels)) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(weights, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (KINDS * BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    epochs = max(epochs, -(-least_steps * batch // len(bags)))      # a small sample is gone over more often
    steps, step = epochs * -(-len(bags) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            now = rate * (1 - step / steps)
            step += 1
            own = [j for j in order[i:i + batch] if len(bags[j][0])]
            if not own:
                continue
            ids = np.concatenate([bags[j][0] for j in own])
            share = np.concatenate([bags[j][1] for j in own]).astype(np.float32)[:, None]
            first = np.cumsum([0, *(len(bags[j][0]) for j in own[:-1])])
            mean = np.add.reduceat(vectors[ids] * share, first, axis=0)
            logits = mean @ layer + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(len(own)), labels[own]] -= 1
            back = (error @ layer.T)[np.repeat(np.arange(len(own)), np.diff([*first, len(ids)]))] * share
            layer -= now / len(own) * (mean.T @ error)
            bias -= now / len(own) * error.sum(axis=0)
            # a bucket in several documents of the batch gets the sum of their gradients
            order_ids = np.argsort(ids, kind="stable")
            distinct, at = np.unique(ids[order_ids], return_index=True)
            vectors[distinct] -= now * np.add.reduceat(back[order_ids], at, axis=0)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(float), float(bias[1] - bias[0]))


def training_bags(docs: DataFrame, labels: DataFrame, max_per_class: int, max_bytes: int = MAX_SAMPLE_BYTES) -> DataFrame:
    """Feature bags of the bounded sample, one per id and label: doc_id, quality, ids, shares.

    At most ``max_per_class`` bags of either label, from at most ``max_bytes``
    of text (the first document counts whatever its size).
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    usable = usable.where(~held_out("doc_id", 4, 2))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = usable.where("quality = 0").orderBy(*by_hash).limit(max_per_class).unionByName(
        usable.where("quality = 1").orderBy(*by_hash).limit(max_per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    # hashes and sizes pick one text per id, so that however many rows an id has, no text is shuffled for it
    texts = texts.withColumn("hash", F.xxhash64("text"))
    sized = (texts.select("doc_id", "hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
             .join(F.broadcast(sample), "doc_id")               # 2 * max_per_class ids at most
             .groupBy("doc_id", "quality").agg(F.min(F.struct("hash", "bytes")).alias("one")).select("doc_id", "quality", "one.*"))
    so_far = F.sum("bytes").over(Window.partitionBy("quality").orderBy(*by_hash).rowsBetween(Window.unboundedPreceding, -1))
    bounded = sized.withColumn("so_far", F.coalesce(so_far, F.lit(0))).where(
        (F.col("so_far") == 0) | (F.col("so_far") + F.col("bytes") <= max_bytes))
    chosen = texts.join(F.broadcast(bounded.select("doc_id", "hash", "quality")), ["doc_id", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()                                            # ids of the sample: rows of one are equal by now
        for batch in batches:
            marks = [pair not in seen and not seen.add(pair) for pair in zip(
                batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist())]
            batch = batch.filter(pa.array(marks, pa.bool_()))
            for chunk in chunks(batch.column("text")):
                found = features(chunk)
                ids, shares = [], []
                for r in range(len(chunk)):
                    own = [np.unique(x[first[r]:last[r]], return_counts=True) for x, first, last in found]
                    ids.append(np.concatenate([distinct for distinct, _ in own]).astype(np.int32))
                    shares.append(np.concatenate([n / max(1, n.sum()) / KINDS for _, n in own]).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, len(chunk)),
                     batch.column("quality").slice(chunk.first, len(chunk)),
                     pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                    ["doc_id", "quality", "ids", "shares"])

    bags = chosen.select("doc_id", "text", "quality").mapInArrow(
        run, "doc_id long, quality int, ids array<int>, shares array<float>")
    return bags.dropDuplicates(["doc_id", "quality"])           # tasks that met the same id made the same bag


def fit(docs: DataFrame, labels: DataFrame, *, max_per_class: int = MAX_PER_CLASS) -> Model:
    sample = training_bags(docs, labels, max_per_class).toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    bags = [(i.values.to_numpy().astype(np.int64), n.values.to_numpy())
            for i, n in zip(sample.column("ids"), sample.column("shares"))]
    return train(bags, sample.column("quality").to_numpy().astype(np.int64))


def score_documents(docs: DataFrame, labels: DataFrame, *, max_per_class: int = MAX_PER_CLASS,
                    threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score (of label 1), predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_per_class=max_per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.score(chunk) for chunk in chunks(batch.column("text"))]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
