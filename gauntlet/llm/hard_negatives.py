"""Hard-negative mining by threshold joins over a partial inverted index (L2AP style).

For every anchor the best rows of its own label are its positives; for every positive, the best rows of other labels
whose score lies in a window below the positive's score are its hard negatives.  Scores are exact integer inner
products of quantised vectors.

Rows are dealt into blocks of about ``block_rows``; every block meets every anchor once (anchors are copied per block,
rows are moved once).  Within a block, anchors are searched in batches against a threshold each:

* dimensions are ordered by their energy in the block; a row's suffix norm times the anchors' largest suffix norm per
  threshold bounds what its last dimensions can add, and the index holds a row only for the dimensions before that
  bound falls under the threshold;
* an anchor's partial scores are accumulated list by list; then rows whose partial score and remaining norms stay
  below the threshold are pruned, and what is left is completed exactly with the dimensions the index omits;
* anchors whose windows are not yet full come again with a lower threshold, down to the windows' floors.

A block gives each window its best rows, so the best of all blocks are the best of all rows; nothing is capped before
that.  The floor of a positive search is none, that of a negative search the lower edge of the windows.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part.  Vectors of
different length are filled up with zeros; an empty vector scores 0.  Rows that repeat an id are rows of their own as
candidates, but no row is a positive of its own id; equal anchors count once, different anchors of one id each have
positives.  Ties go to the smaller id.  Components are bounded: their largest square times the number of dimensions
stays below 2**53, else an error is raised rather than a wrong score returned.  An empty table, and anchors without
positives or negatives, give no rows.  Only the three columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gauntlet.llm.common import materialise

BLOCK_ROWS = 2048           # a block of 64 dimensions takes 1 MB, and as much again for its index
BATCH_ANCHORS = 256
STEPS = 4                   # thresholds between the highest and the floor
NO_FLOOR = np.iinfo(np.int64).min

_ROW, _ANCHOR = 0, 1


def quantised(vectors: DataFrame, label: Column, *, id_col: str = "vec_id", vector_col: str = "embedding",
              scale: float = 256.0) -> DataFrame:
    """(vec_id, label, vec): the rows that take part, components as floor(scale * x)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~bad)
    return rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("int")))


# ---------------------------------------------------------------- search within a block

@dataclass
class Block:
    """Rows of one block; ``vec`` is rows x dimensions, as floats that hold the integers exactly."""

    ids: np.ndarray
    labels: np.ndarray
    vec: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(-(self.vec ** 2).sum(axis=0), kind="stable")
        self.vec = np.ascontiguousarray(self.vec[:, self.order])
        self.norms = suffix_norms(self.vec)

    def aligned(self, vec: np.ndarray) -> np.ndarray:
        """Anchors' vectors in the block's order of dimensions, both filled up with zeros to one length."""
        width = self.vec.shape[1]
        if vec.shape[1] > width:
            more = np.arange(width, vec.shape[1])
            self.order = np.concatenate([self.order, more])
            self.vec = np.hstack([self.vec, np.zeros((len(self.ids), len(more)))])
            self.norms = suffix_norms(self.vec)
        elif vec.shape[1] < width:
            vec = np.hstack([vec, np.zeros((len(vec), width - vec.shape[1]))])
        return np.ascontiguousarray(vec[:, self.order])


def suffix_norms(vec: np.ndarray) -> np.ndarray:
    """Norm of each vector from dimension j on, for j from 0 to the number of dimensions; a little too large."""
    squares = np.zeros((len(vec), vec.shape[1] + 1))
    squares[:, :-1] = np.cumsum((vec ** 2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(squares) * (1 + 1e-9)


class PartialIndex:
    """Inverted lists of a block for anchors with the given thresholds.

    Row i is in the lists of its first ``c_i`` dimensions: from there on its suffix norm times the largest ratio of an
    anchor's suffix norm to its threshold is below 1, so what is left out cannot reach a threshold by itself.  Rows
    are sorted by ``c_i``, so that each list is a prefix of them.
    """

    def __init__(self, block: Block, members: np.ndarray, norms: np.ndarray, thresholds: np.ndarray):
        """``members``: rows of the block to index; ``norms``: the anchors' suffix norms."""
        width = block.vec.shape[1]
        if width and (thresholds > 0).all():
            reach = (norms[:, :-1] / thresholds[:, None]).max(axis=0)
            covered = block.norms[members, :-1] * reach < 1
            kept = np.where(covered.any(axis=1), covered.argmax(axis=1), width)
        else:
            kept = np.full(len(members), width)
        by = np.argsort(-kept, kind="stable")
        self.rows, kept = members[by], kept[by]
        self.lengths = np.searchsorted(-kept, -np.arange(width), "left")      # rows with c_i > j
        self.lists = [np.ascontiguousarray(block.vec[self.rows[:n], j]) for j, n in enumerate(self.lengths)]
        self.norms = block.norms[self.rows, np.minimum(kept, width)]             # what the index omits of each row
        self.kept, self.block = kept, block

    def search(self, vec: np.ndarray, norms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows (of the block) that reach the threshold, and their exact scores."""
        n = int(self.lengths[0]) if len(self.lengths) else len(self.rows)
        score = np.zeros(n)
        for j, size in enumerate(self.lengths):
            if not size:
                break
            if vec[j]:
                score[:size] += vec[j] * self.lists[j]
        width = len(vec)
        left = self.norms[:n] * norms[np.minimum(self.kept[:n], width)]          # Cauchy-Schwarz over the omitted
        alive = np.flatnonzero(score + left >= threshold - 0.5)
        rows, score, kept = self.rows[alive], score[alive], self.kept[alive]
        # rows of equal coverage are neighbours: complete them together
        edges = np.flatnonzero(np.diff(kept, prepend=-1, append=-1)) if len(kept) else np.zeros(0, int)
        for a, b in zip(edges[:-1], edges[1:]):
            c = kept[a]
            if c < width:
                score[a:b] += self.block.vec[rows[a:b], c:] @ vec[c:]
        reached = score >= threshold
        return rows[reached], score[reached]


def best_rows(block: Block, members: np.ndarray, vec: np.ndarray, own_ids: np.ndarray | None, highest: list[np.ndarray],
              lowest: list[np.ndarray], wanted: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each anchor and window [lowest, highest], the ids and scores of the block's ``wanted`` best rows.

    Best is by score, then smaller id; rows with the id in ``own_ids`` are left out.  Thresholds start near the highest
    possible score and fall until each window of an anchor is full or has reached its floor.
    """
    norms = suffix_norms(vec)
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    out: list[list] = [[None if a <= b else nothing for a, b in zip(lowest[i], h)] for i, h in enumerate(highest)]
    longest = float(block.norms[members, 0].max()) if len(members) else 0.0
    top = np.array([min(norms[i, 0] * longest, float(h.max()) if len(h) else 0.0) for i, h in enumerate(highest)])
    floor = np.array([float(low.min()) if len(low) else 0.0 for low in lowest])
    bottom = np.maximum(floor, -norms[:, 0] * longest - 1)
    open_ = [i for i, windows in enumerate(out) if any(x is None for x in windows)]
    for step in range(1, STEPS + 1):
        if not open_:
            break
        at = np.array(open_)
        # a search without a floor looks for scores over 0 first, and at the last step for all
        low = bottom[at] if step == STEPS else np.maximum(bottom[at], 0)
        thresholds = np.ceil(top[at] - (top[at] - low) * step / STEPS) if step < STEPS else low
        index = PartialIndex(block, members, norms[at], thresholds)
        still = []
        for i, t in zip(open_, thresholds):
            rows, scores = index.search(vec[i], norms[i], t)
            ids = block.ids[rows]
            if own_ids is not None:
                ids, scores = ids[ids != own_ids[i]], scores[ids != own_ids[i]]
            by = np.lexsort((ids, -scores))
            ids, scores = ids[by], scores[by]
            for k in range(len(highest[i])):
                if out[i][k] is not None:
                    continue
                first = np.searchsorted(-scores, -float(highest[i][k]), "left")
                last = np.searchsorted(-scores, -float(lowest[i][k]), "right")
                if min(last, len(scores)) - first >= wanted or t <= max(lowest[i][k], bottom[i]):
                    end = min(first + wanted, max(last, first))
                    out[i][k] = (ids[first:end], scores[first:end].astype(np.int64))
            if any(x is None for x in out[i]):
                still.append(i)
        open_ = still
    return out


# ---------------------------------------------------------------- Spark side

_FOUND = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "anchor long, window int, vec_id long, score long"
_SENT = ("block", "kind", "anchor", "vec_id", "label", "vec", "highest", "lowest")


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of int lists as one float matrix, filled up with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), int(lengths.max()) if len(lengths) else 0))
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    if out.size and np.abs(out).max() ** 2 * out.shape[1] >= 2 ** 53:
        raise OverflowError("an inner product might not be an exact double")
    return out


def search_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, wanted: int, same_label: bool) -> DataFrame:
    """(anchor, window, vec_id, score): each block's ``wanted`` best rows for each window of each anchor.

    ``rows``: block, vec_id, label, vec.  ``anchors``: anchor (a key), vec_id, label, vec, highest, lowest (arrays).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, block_no, ready = [], None, {}
        for batch in batches:
            # a block's rows come before its anchors; cut the batch where block or kind change
            numbers, kinds = (batch.column(c).to_numpy() for c in ("block", "kind"))
            edges = [0, *(np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1), len(numbers)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                part = pa.table(batch.slice(a, b - a))
                if numbers[a] != block_no:
                    parts, block_no, ready = [], numbers[a], {}
                if kinds[a] == _ROW:
                    parts.append(part)
                    continue
                if parts:
                    ready, parts = _block(pa.concat_tables(parts)), []
                if ready:
                    for i in range(0, b - a, BATCH_ANCHORS):
                        yield from _search(ready, part.slice(i, BATCH_ANCHORS), wanted, same_label)

    sent_rows = rows.select("block", F.lit(_ROW).alias("kind"), F.lit(None).cast("long").alias("anchor"), "vec_id", "label",
                            "vec", *(F.lit(None).cast("array<long>").alias(c) for c in ("highest", "lowest")))
    sent_anchors = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn(
        "kind", F.lit(_ANCHOR)).select(*_SENT)
    sent = sent_rows.unionByName(sent_anchors).repartition("block").sortWithinPartitions("block", "kind")
    return sent.mapInArrow(run, _FOUND_SQL)


def _block(table: pa.Table) -> dict:
    block = Block(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("vec")))
    labels, inverse = np.unique(block.labels, return_inverse=True)
    return {"block": block, "of": {int(v): np.flatnonzero(inverse == k) for k, v in enumerate(labels)}}


def _search(ready: dict, table: pa.Table, wanted: int, same_label: bool) -> Iterator[pa.RecordBatch]:
    block, of = ready["block"], ready["of"]
    vec, ids, labels = block.aligned(_matrix(table.column("vec"))), table.column("vec_id").to_numpy(), table.column("label").to_numpy()
    keys = table.column("anchor").to_numpy()
    highest, lowest = ([np.array(x, np.int64) for x in table.column(c).to_pylist()] for c in ("highest", "lowest"))
    for label in np.unique(labels):
        mine = np.flatnonzero(labels == label)
        own = of.get(int(label), np.zeros(0, int))
        members = own if same_label else np.setdiff1d(np.arange(len(block.ids)), own, assume_unique=True)
        if not len(members):
            continue
        found = best_rows(block, members, vec[mine], ids[mine] if same_label else None, [highest[i] for i in mine], [lowest[i] for i in mine], wanted)
        rows = [(np.full(len(got), keys[i]), np.full(len(got), k, np.int32), got, scores)
                for i, windows in zip(mine, found) for k, (got, scores) in enumerate(windows)]
        if rows:
            columns = [np.concatenate(c) for c in zip(*rows)]
            yield from pa.table(dict(zip(_FOUND.names, columns))).cast(_FOUND).to_batches()


def _ranked(found: DataFrame, wanted: int, keys: list[str]) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wanted)


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 5,
                        low: tuple[int, int] = (80, 100), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per anchor, positive and hard negative; ``rows`` as ``quantised`` gives them.

    A negative's score is at most the positive's and at least ``low[0] / low[1]`` of it; the best ``negatives`` of
    them are returned, all if there are fewer.
    """
    total = rows.count()
    blocks = max(1, -(-total // block_rows))
    # the row's number takes part, so that rows of one id are dealt over all blocks
    number = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    dealt = materialise(rows.withColumn("block", number), "negatives-rows")
    key = F.xxhash64("vec_id", "label", "vec")
    anchors = dealt.where(is_anchor).select("vec_id", "label", "vec").dropDuplicates().withColumn("anchor", key)
    every = F.array(F.lit(np.iinfo(np.int64).max))
    searched = search_blocks(dealt, anchors.withColumn("highest", every).withColumn("lowest", F.array(F.lit(NO_FLOOR))),
                             blocks, positives, True)
    best = _ranked(searched, positives, ["anchor"]).groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))
    chosen = anchors.join(best, "anchor").withColumn("highest", F.transform("found", lambda p: p["score"]))
    # the least integer at or over low * score; DIV rounds towards zero
    least = F.expr(f"transform(highest, p -> ({low[0]} * p + if(p > 0, {low[1] - 1}, 0)) DIV {low[1]})")
    chosen = materialise(chosen.withColumn("lowest", least), "negatives-positives")
    searched = search_blocks(dealt, chosen.drop("found"), blocks, negatives, False)
    ranked = _ranked(searched, negatives, ["anchor", "window"])
    joined = ranked.join(chosen.select("anchor", F.col("vec_id").alias("anchor_id"), "found"), "anchor")
    positive = F.element_at("found", F.col("window") + 1)
    return joined.select("anchor_id", positive["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
                         positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """The query: every seventh id has the next label; anchors are the ids divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(quantised(embeddings, label), F.col("vec_id") % 100 == 0)
