"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Documents and test items that share a seed (a run of ``min_match`` words,
A-Z lower-cased) are joined; each such pair is tiled: the longest common runs
of words that are not yet covered are marked first, then shorter ones, down
to ``min_match`` words.  A document is contaminated by an item when the tiles
cover at least ``coverage`` of the item's words, in whatever order they come.

Documents are first passed through a bitmap of the benchmark's seeds (8 MB,
whatever its size; no seed is missed), so only suspects are joined.

Cases: null and empty texts have no words; an item without words matches
nothing; an item of fewer than ``min_match`` words matches as a whole.  Items
with the same words are reported once, under the least id.  Repeated
documents are judged each.  Equal tiles are taken from the left.  Only the
named columns are read, so other columns cannot clash.  Empty tables give an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauntlet.llm.common import bitmap, in_bitmap, lean, materialise, without_ids
from gauntlet.llm.textkernel import chunks, mix, signed, span_hashes, window_hashes

MIN_MATCH, COVERAGE = 5, 0.5


def greedy_tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, words) of two sequences of word hashes."""
    min_match = min(min_match, len(item))
    if not min_match or len(doc) < min_match:
        return []
    free_doc, free_item = np.ones(len(doc), dtype=bool), np.ones(len(item), dtype=bool)
    tiles, length = [], min(len(doc), len(item))
    while True:
        found, longest = _scan(doc, item, free_doc, free_item, length)
        if longest > 2 * length:                      # look again for such long matches first
            length = longest
            continue
        for n, d, i in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_doc[d:d + n].all() and free_item[i:i + n].all():
                free_doc[d:d + n] = free_item[i:i + n] = False
                tiles.append((d, i, n))
            elif n > length:                          # partly covered by a longer tile: what is left is found again
                found = None
        if found is None:
            continue
        if length == min_match:
            return tiles
        length = max(min_match, length // 2)


def _free_starts(free: np.ndarray, length: int) -> np.ndarray:
    blocked = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(blocked[length:] == blocked[:-length])


def _scan(doc, item, free_doc, free_item, length):
    """Maximal free matches of at least ``length`` words: by window hashes, then extended word by word."""
    starts_i, starts_d = _free_starts(free_item, length), _free_starts(free_doc, length)
    if not len(starts_i) or not len(starts_d):
        return [], 0
    table: dict[int, list[int]] = {}
    hashes_i = window_hashes(item, length) if length <= 64 else _long_windows(item, length)
    hashes_d = window_hashes(doc, length) if length <= 64 else _long_windows(doc, length)
    for i in starts_i.tolist():
        table.setdefault(int(hashes_i[i]), []).append(i)
    starts_d = starts_d[np.isin(hashes_d[starts_d], hashes_i[starts_i])]
    found, longest = [], 0
    for d in starts_d.tolist():
        for i in table[int(hashes_d[d])]:
            if d and i and free_doc[d - 1] and free_item[i - 1] and doc[d - 1] == item[i - 1]:
                continue                              # part of a match that begins earlier
            n = length
            while (d + n < len(doc) and i + n < len(item) and free_doc[d + n] and free_item[i + n]
                   and doc[d + n] == item[i + n]):
                n += 1
            found.append((n, d, i))
            longest = max(longest, n)
    return found, longest


def _long_windows(words: np.ndarray, length: int) -> np.ndarray:
    """Rolling hash of long windows from prefix sums."""
    base = np.uint64(0x9E3779B97F4A7C15)
    up = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(words), base))])
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    down = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(words), inverse))])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:-1], dtype=np.uint64)])
    n = len(words) - length + 1
    return mix((sums[length:length + n] - sums[:n]) * down[:n])


def _word_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    for chunk in chunks(batch.column("text"), lower=True):
        starts, ends, rows = chunk.words()
        words = span_hashes(chunk.data, starts, ends)
        yield chunk.first, [words[rows[r]:rows[r + 1]] for r in range(len(chunk))]


def _items(benchmark: DataFrame, min_match: int) -> DataFrame:
    """Distinct items: item_id, n, words (binary), seeds with the number of their places in the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in _word_rows(batch):
                ids = batch.column("item_id").slice(first, len(rows))
                seeds = [np.unique(window_hashes(w, min(min_match, len(w))), return_counts=True) for w in rows]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(w) for w in rows], pa.int64()), pa.array([w.tobytes() for w in rows], pa.binary()),
                     pa.array([signed(h) for h, _ in seeds], pa.list_(pa.int64())),
                     pa.array([c for _, c in seeds], pa.list_(pa.int64()))], ["item_id", "n", "item_words", "seeds", "places"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(lean(run), "item_id long, n long, item_words binary, seeds array<long>, places array<long>").where("n > 0")
    return rows.groupBy("item_words").agg(F.min("item_id").alias("item_id"), F.first("n").alias("n"),
                                          F.first(F.arrays_zip("seeds", "places")).alias("seeds"))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH,
                       coverage: float = COVERAGE) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, item_tokens, covered, coverage,
    tiles (array of doc_start, item_start, words; word positions)."""
    spark = docs.sparkSession
    items = materialise(_items(benchmark, min_match), "benchmark-items")
    seeds = items.select("item_id", "n", F.explode("seeds").alias("s")).select(
        "item_id", "n", F.col("s.seeds").alias("seed"), F.col("s.places").alias("places"))
    widths = sorted(r[0] for r in items.select(F.least("n", F.lit(min_match))).distinct().collect())  # min_match at most
    marks = spark.sparkContext.broadcast(bitmap(seeds.select("seed")))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, rows in _word_rows(batch):
                out = []
                for r, words in enumerate(rows):
                    hits = [h[in_bitmap(marks.value, h)] for h in (window_hashes(words, w) for w in widths)]
                    hits = np.unique(np.concatenate(hits)) if hits else ()
                    if len(hits):
                        out.append((ids[first + r], words.tobytes(), signed(hits)))
                if out:
                    a, b, c = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary()),
                                                      pa.array(c, pa.list_(pa.int64()))], ["doc_id", "words", "hits"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(lean(suspects), "doc_id long, words binary, hits array<long>")
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "suspects")
    # every tile has a seed for each start within it, so an item whose shared seeds have fewer places than this (a
    # repeated seed counts at each of them) cannot reach the coverage
    least = F.lit(coverage) * F.col("n") / min_match - 1e-9
    pairs = found.select("row", F.explode("hits").alias("seed")).join(seeds, "seed").groupBy("row", "item_id", "n").agg(
        F.sum("places").alias("shared")).where(F.col("shared") >= least).select("row", "item_id")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("words", pa.int32())]))
        for batch in batches:
            tiles = [greedy_tiles(np.frombuffer(d.as_buffer(), np.uint64), np.frombuffer(i.as_buffer(), np.uint64), min_match)
                     for d, i in zip(batch.column("words"), batch.column("item_words"))]
            rows = [[{"doc_start": d, "item_start": i, "words": n} for d, i, n in sorted(t)] for t in tiles]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("item_id"), batch.column("n"),
                 pa.array([sum(n for _, _, n in t) for t in tiles], pa.int64()), pa.array(rows, kind)],
                ["doc_id", "item_id", "item_tokens", "covered", "tiles"])

    both = pairs.join(found.select("row", "doc_id", "words"), "row").join(items.select("item_id", "n", "item_words"), "item_id")
    tiled = both.select("doc_id", "item_id", "n", "words", "item_words").mapInArrow(
        lean(tile), "doc_id long, item_id long, item_tokens long, covered long, "
              "tiles array<struct<doc_start:int,item_start:int,words:int>>")
    share = F.col("covered") / F.col("item_tokens")
    return tiled.where(share >= coverage).select("doc_id", "item_id", "item_tokens", "covered", share.alias("coverage"), "tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no test item contaminates, with their columns as they are."""
    return without_ids(docs, contaminated_pairs(docs, benchmark, **options).select("doc_id"))
