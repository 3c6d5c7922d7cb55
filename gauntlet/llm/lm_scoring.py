"""Language-model scoring with a weighted backoff automaton over corpus n-grams.

Tokens are words (A-Z lower-cased) and one end per text.  All n-grams up to
``order`` of all training texts are counted, none is cut off.  Smoothing is
towards the next shorter context (``strength`` pseudo-counts), down to
add-0.1 unigrams, so each state's arcs and failure arc sum to one.

The model is as large as the corpus, so it is never gathered in one place.
Texts are dealt into blocks of about ``block_bytes``.  A block's distinct
n-grams and training counts go, in as many buckets as there are blocks, to
the tasks that add them up; each bucket answers with the total counts of just
the n-grams the block asked for.  From its slice a block builds the automaton:
contexts are states, seen n-grams arcs, and a failure arc leads to the state
of the next shorter context.  One pass from left to right carries the state.

Cases: a null or empty text is just its end.  Repeated rows count as often as
they occur and are scored each; a null id is not held out.  Without training
texts N and V are 0.  A text longer than a block is a block's share of its
own, scored whole.  Only the id and text columns are read, so other columns
cannot clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauntlet.llm.common import held_out
from gauntlet.llm.textkernel import chunks, mix, span_hashes, window_hashes

ORDER, STRENGTH, ADD = 2, 5.0, 0.1
BLOCK_BYTES = 4 << 20
BEGIN, END = np.split(mix(np.array([1, 2], np.uint64) * np.uint64(0xA0761D6478BD642F)), 2)
_TOKEN = np.uint64(1)            # lowest bit of a key: it is a token (counts for N and V)


@dataclass
class Grams:
    """The n-grams of a block: a key for each distinct one, and which one ends at each place.

    Places are the tokens of all texts, one text after the other; each text
    is preceded by one place for its beginning.  ``at[m]`` numbers the n-gram
    of m tokens that ends at a place.
    """

    keys: np.ndarray
    at: dict[int, np.ndarray]
    first: np.ndarray            # place of each text's beginning, and the number of places

    def is_token(self) -> np.ndarray:
        token = np.ones(int(self.first[-1]), dtype=bool)
        token[self.first[:-1]] = False
        return token


def grams(texts: pa.ChunkedArray, order: int) -> Grams:
    pad, parts, sizes = max(1, order - 1), [], []
    for chunk in chunks(texts, lower=True):
        starts, ends, rows = chunk.words()
        words = span_hashes(chunk.data, starts, ends)
        for r in range(len(chunk)):
            own = words[rows[r]:rows[r + 1]]
            parts += [np.repeat(BEGIN, pad), own, END]
            sizes.append(len(own) + 1)
    sizes = np.array(sizes, np.int64)
    sequence = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    # places: the last padding of each text and its tokens
    starts = np.cumsum(sizes + pad) - sizes - 1
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    place = np.repeat(starts - first[:-1], sizes + 1) + np.arange(first[-1])
    padded = np.concatenate([np.repeat(BEGIN, order), sequence])
    hashes = []
    for m in range(1, order + 1):
        h = window_hashes(padded, m)[place + order - m + 1] & ~_TOKEN
        hashes.append(h)
    token = np.ones(len(place), dtype=bool)
    token[first[:-1]] = False
    hashes[0][token] |= _TOKEN
    keys, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return Grams(keys, {m: at[(m - 1) * len(place):m * len(place)] for m in range(1, order + 1)}, first)


def training_counts(g: Grams, train: np.ndarray) -> np.ndarray:
    """How often each key occurs in the training texts; a beginning counts as a context only."""
    weight = np.repeat(train, np.diff(g.first))
    token, total = g.is_token(), np.zeros(len(g.keys), np.int64)
    for m, at in g.at.items():
        use = weight & token if m == max(g.at) and m > 1 else weight
        total += np.bincount(at[use], minlength=len(g.keys))
    return total


class Automaton:
    """States, arcs and failure arcs of the n-grams of a block, from total counts.

    State 0 is the empty context.  ``step`` numbers the arc of (state, token);
    a state without it fails to the state of its next shorter context.
    """

    def __init__(self, g: Grams, counts: np.ndarray, n: int, v: int, order: int, strength: float):
        token = g.is_token()
        places = np.flatnonzero(token)
        base = (counts + ADD) / (n + ADD * (v + 1))
        self.root = np.log10(base).tolist()                       # arcs of the empty context, by token
        self.width = len(g.keys) + 1
        state = lambda m, at: np.where(counts[g.at[m][at]] > 0, g.at[m][at] + 1, 0)
        # a state is 1 + the key of its context; its failure arc leads to the context without the first token
        self.fail, self.fail_weight = np.zeros(self.width, np.int64), np.zeros(self.width)
        for m in range(1, order):
            own = g.at[m]
            if m > 1:
                self.fail[own + 1] = state(m - 1, slice(None))
            self.fail_weight[own + 1] = np.log10(strength / (counts[own] + strength))
        self.fail, self.fail_weight = self.fail.tolist(), self.fail_weight.tolist()
        after = np.zeros(len(token), np.int64)                    # longest context that is a state, by place
        for m in range(1, order):
            now = state(m, slice(None))
            after = np.where(now > 0, now, after)
        self.start = after
        _, one = np.unique(g.at[1][places], return_index=True)
        self.root_next = np.zeros(len(g.keys), np.int64)
        if order > 1:
            self.root_next[g.at[1][places[one]]] = state(1, places[one])
        self.root_next = self.root_next.tolist()
        p, arcs, weights, targets = base[g.at[1][places]], [], [], []
        for m in range(2, order + 1):
            context, own = g.at[m - 1][places - 1], g.at[m][places]
            p = (counts[own] + strength * p) / (counts[context] + strength)
            _, one = np.unique(own, return_index=True)
            one = one[counts[own[one]] > 0]
            arcs.append((context[one] + 1) * self.width + g.at[1][places[one]])
            weights.append(np.log10(p[one]))
            goal = np.zeros(len(one), np.int64)
            for short in range(1, min(m, order - 1) + 1):
                now = state(short, places[one])
                goal = np.where(now > 0, now, goal)
            targets.append(goal)
        join = lambda x: np.concatenate(x).tolist() if x else []
        keys = join(arcs)
        self.step, self.weight, self.next = dict(zip(keys, range(len(keys)))), join(weights), join(targets)

    def score(self, tokens: list[int], state: int) -> float:
        """Log10 probability of the tokens (numbers of their keys), read from left to right."""
        step, weight, goal, fail, fail_weight = self.step, self.weight, self.next, self.fail, self.fail_weight
        root, root_next, width, total = self.root, self.root_next, self.width, 0.0
        for token in tokens:
            while state:
                arc = step.get(state * width + token)
                if arc is not None:
                    total += weight[arc]
                    state = goal[arc]
                    break
                total += fail_weight[state]
                state = fail[state]
            else:
                total += root[token]
                state = root_next[token]
        return total


def _pack(counts: np.ndarray) -> bytes:
    """Counts in a byte each; 255 stands for a larger one, which follows at the end."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.uint64).tobytes()


def _unpack(data: pa.Buffer, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.uint64, offset=n) if len(data) > n else 0
    return counts


def _ask(order: int, buckets: int):
    def run(key, table):
        g = grams(table.column("text"), order)
        counts = training_counts(g, ~table.column("held_out").to_numpy(zero_copy_only=False))
        bucket = (mix(g.keys) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
        keys, counts = g.keys[by], counts[by]
        parts = [slice(cut[b], cut[b + 1]) for b in range(buckets)]
        return pa.table({"bucket": pa.array(range(buckets), pa.int64()), "block": pa.array([key[0].as_py()] * buckets, pa.int64()),
                         "keys": pa.array([keys[s].tobytes() for s in parts], pa.binary()),
                         "counts": pa.array([_pack(counts[s]) for s in parts], pa.binary())})

    return run


def _total(table: pa.Table) -> pa.Table:
    """Adds up a bucket's counts and answers each block, in the order of its keys; with the bucket's N and V."""
    asked = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
    counts = np.concatenate([_unpack(x.as_buffer(), len(a)) for x, a in zip(table.column("counts"), asked)])
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(at, counts, len(keys)).astype(np.int64)
    token = (keys & _TOKEN) > 0
    ends = np.cumsum([len(a) for a in asked])
    answers = [_pack(total[at[end - len(a):end]]) for a, end in zip(asked, ends)]
    n, v = int(total[token].sum()), int((total[token] > 0).sum())
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                     "totals": pa.array(answers, pa.binary()), "n": pa.array([n] * len(asked), pa.int64()),
                     "v": pa.array([v] * len(asked), pa.int64())})


def _answer(order: int, strength: float, buckets: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(texts, answers):
        g = grams(texts.column("text"), order)
        bucket = (mix(g.keys) % np.uint64(buckets)).astype(np.int64)
        by, answers = np.argsort(bucket, kind="stable"), answers.sort_by("bucket")
        sizes = np.bincount(bucket, minlength=buckets)
        counts = np.zeros(len(g.keys), np.int64)
        counts[by] = np.concatenate([_unpack(x.as_buffer(), size) for x, size in zip(answers.column("totals"), sizes)])
        n, v = sum(answers.column("n").to_pylist()), sum(answers.column("v").to_pylist())
        machine = Automaton(g, counts, n, v, order, strength)
        token, own = g.is_token(), counts[g.at[1]]
        base = np.where(token, np.log10((own + ADD) / (n + ADD * (v + 1))), 0)
        first = g.first[:-1]
        tokens, scores = g.at[1].tolist(), []
        for lo, hi in zip(g.first[:-1].tolist(), g.first[1:].tolist()):
            scores.append(machine.score(tokens[lo + 1:hi], int(machine.start[lo])))
        return pa.Table.from_arrays([
            texts.column("doc_id"), texts.column("held_out"), pa.array(np.diff(g.first) - 1),
            pa.array(np.add.reduceat((token & (own > 0)).astype(np.int64), first)),
            pa.array(np.full(len(first), n, np.int64)), pa.array(np.add.reduceat(base, first)),
            pa.array(scores, pa.float64())], names=names)

    return run


def dealt(docs: DataFrame, blocks: int, modulus: int) -> DataFrame:
    """The texts with their blocks.  Rows are dealt by id and row number, so equal rows spread over the blocks.

    Rows are numbered in the order of their values in a partition, so a task
    that is run again after a lost executor deals them as before.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.sortWithinPartitions("doc_id", "text").select(
        "doc_id", "text", held_out("doc_id", modulus, 0).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)).alias("block"))


def score_documents(docs: DataFrame, *, order: int = ORDER, strength: float = STRENGTH,
                    block_bytes: int = BLOCK_BYTES, modulus: int = 10) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Texts whose crc32(doc_id) mod ``modulus`` is 0 are held out: scored, but not learned from.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    texts = dealt(docs, blocks, modulus)
    asked = texts.groupBy("block").applyInArrow(_ask(order, blocks), "bucket long, block long, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_total, "block long, bucket long, totals binary, n long, v long")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _answer(order, strength, blocks),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
