"""N-gram Jaccard join: count vectors in R-trees bound the overlap, surviving pairs are verified.

A document's set is its distinct word 5-gram hashes (A-Z lower-cased).  The
set's hashes are dealt into groups; the group counts are a point, and two
sets share at most the sum of the coordinate minima.  Points are indexed in
R-trees, one for each shared routing key and band of sizes: two sets with
Jaccard 0.8 share one of the first ``n - ceil(0.8 n) + 1`` hashes in any fixed
order (the smaller one even of its first ``n - ceil(1.6 n / 1.8) + 1``), and
their sizes differ by a quarter at most, so no other tree needs a search.
(One tree over all documents cannot prune: the counts of unrelated texts of
one length differ too little in any few coordinates.)  Pairs that the bound
allows are verified on whole sets.

The result needs links only as far as they join components, so work goes in
two rounds: in each tree, all points against its most typical one; then, in
trees that still hold several components, every pair of points of different
components that the bound allows.  No link between components is lost, and a
group of copies is not expanded into all pairs.  Equal sets are one point.

Sets and words are compared by 64-bit hashes.

Cases: a null or empty text, or one without words, has an empty set and is
linked with nothing (its component is its own id); a text of fewer than five
words is one shingle.  Repeated rows give repeated rows.  A null id takes
part; the component is the least non-null id of its group.  Only the id and
text columns are read, so other columns cannot clash.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauntlet.llm.common import batches_of, bitmap, in_bitmap, lean, materialise, of_documents, written
from gauntlet.llm.count_rtree import LEAF, CountRTree, overlap_needed
from gauntlet.llm.graph import components
from gauntlet.llm.textkernel import chunks, mix, shingle_set, signed, span_hashes

WIDTH, PERCENT = 5, 80
LEAST_GROUPS = 64                # coordinates of a point: a power of two, half the set's size or more
SHARD = 4096                     # points of one tree at most; a larger group is dealt over several
COMMON_SAMPLE, COMMON_SEEN = 8, 2


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        for chunk in chunks(batch.column("text"), lower=True):
            starts, ends, rows = chunk.words()
            words = span_hashes(chunk.data, starts, ends)
            yield batch, chunk.first, [shingle_set(words[rows[r]:rows[r + 1]], width) for r in range(len(chunk))]


def fingerprint(shingles: np.ndarray) -> np.uint64:
    """64 bits of a set, whatever the order."""
    with np.errstate(over="ignore"):
        return mix(np.array([mix(shingles).sum() + np.uint64(len(shingles))]))[0]


def routing_keys(shingles: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The set's first hashes: those not marked common before the others, each by value."""
    n = len(shingles)
    keep = n - -(-percent * n // 100) + 1
    late = in_bitmap(common, shingles)
    return np.concatenate([shingles[~late], shingles[late]])[:keep]


def leading(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of the first hashes must hold a common one if the set is the smaller of two similar ones."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """Counts of the hashes by group, two to a byte; as many groups as it takes for 15 to be enough."""
    groups = max(LEAST_GROUPS, 1 << int(len(shingles) // 2).bit_length())
    while True:
        counts = np.bincount((shingles >> np.uint64(24) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max() < 16:
            return (counts[0::2] | counts[1::2] << 4).astype(np.uint8)
        groups *= 2


def fold(vector: bytes, groups: int) -> np.ndarray:
    """The counts over fewer groups (a divisor of the vector's)."""
    packed = np.frombuffer(vector, np.uint8)
    counts = np.empty(2 * len(packed), np.uint8)
    counts[0::2], counts[1::2] = packed & 15, packed >> 4
    return counts.reshape(-1, groups).sum(axis=0, dtype=np.uint16)


def bound(v: bytes, w: bytes) -> int:
    """At most so many elements are in both sets."""
    groups = 2 * min(len(v), len(w))
    return int(np.minimum(fold(v, groups), fold(w, groups)).sum())


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """A bitmap of shingles that many texts hold; it only orders the routing keys.

    Counted in one text in COMMON_SAMPLE.  Any order gives the same result;
    this one keeps trees small, as a common passage is rarely a routing key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sets in _sets(batches, width):
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sets)))], ["shingle"])

    sample = texts.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(COMMON_SAMPLE)) == 0).select("text")
    seen = sample.mapInArrow(lean(run), "shingle long").groupBy("shingle").count()
    return bitmap(seen.where(F.col("count") >= COMMON_SEEN).select("shingle"))


def profile(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """One row per text: doc_id, n, class (of equal sets; null if empty), vector, keys."""
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, width))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("vector", pa.binary()),
                        ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, sets in _sets(batches, width):
            prints = signed(np.array([fingerprint(s) for s in sets], np.uint64))
            yield from batches_of(pa.table({
                "doc_id": batch.column("doc_id").slice(first, len(sets)),
                "n": [len(s) for s in sets],
                "class": pa.array(prints, mask=np.array([not len(s) for s in sets], bool)),
                "vector": pa.array([count_vector(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                "keys": pa.array([signed(routing_keys(s, common.value, percent)) if len(s) else None for s in sets],
                                 pa.list_(pa.int64()))}), schema)

    return texts.mapInArrow(lean(run), "doc_id long, n long, class long, vector binary, keys array<long>")


def _routed(rows: DataFrame, shared: np.ndarray, percent: int) -> DataFrame:
    """Classes that have a shared routing key: class, n, vector, keys (those shared), lead (which of them
    are among the leading ones) and typical (share of its keys that are shared, in thousandths)."""
    marks = rows.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            values, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            inside = in_bitmap(marks.value, values)
            starts = np.cumsum(sizes) - sizes
            ends = np.concatenate([[0], np.cumsum(inside)])[np.concatenate([[0], np.cumsum(sizes)])]
            place = np.arange(len(values)) - np.repeat(starts, sizes)
            lead = place < np.repeat(leading(batch.column("n").to_numpy(), percent), sizes)
            of = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[inside], kind))
            out = pa.RecordBatch.from_arrays(
                [batch.column("class"), batch.column("n"), batch.column("vector"), of(values, pa.int64()), of(lead, pa.bool_()),
                 pa.array(1000 * np.diff(ends) // np.maximum(sizes, 1), pa.int32())],
                ["class", "n", "vector", "keys", "lead", "typical"])
            yield out.filter(pa.array(np.diff(ends) > 0))

    found = rows.where(F.col("class").isNotNull()).select("class", "n", "vector", "keys")
    found = found.mapInArrow(lean(run), "class long, n long, vector binary, keys array<long>, lead array<boolean>, typical int")
    return found.dropDuplicates(["class"])


def _bounded(pairs: DataFrame, routed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose count vectors allow the similarity."""
    side = lambda x: routed.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("vector").alias(f"v_{x}"))
    long_enough = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            keep = [bound(v, w) >= overlap_needed(n, m, percent)
                    for v, n, w, m in zip(c["v_a"], c["n_a"], c["v_b"], c["n_b"])]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(long_enough)
    return joined.select("a", "b", "n_a", "n_b", "v_a", "v_b").mapInArrow(lean(run), "a long, b long")


@written("verified")
def _verified(pairs: DataFrame, texts: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose whole sets have the similarity."""
    pairs = materialise(pairs, "candidates")
    used = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    chosen = texts.sparkSession.sparkContext.broadcast(bitmap(members.join(used, "class").select("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, sets in _sets(of_documents(batches, chosen.value, nulls=True), width):
            kept = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.array([fingerprint(s) for s in kept], np.uint64))),
                                              pa.array([s.tobytes() for s in kept], pa.binary())], ["class", "set"])

    sets = texts.mapInArrow(lean(run), "class long, set binary").dropDuplicates(["class"])
    sets = materialise(sets.join(used, "class", "left_semi"), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("class").alias(x), F.col("set").alias(f"s_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b")
    return joined.mapInArrow(lean(check), "a long, b long")


def _search_runs(percent: int):
    """Within each run of rows of one tree, pairs of different components that the bound allows.

    Of two rows at home the smaller must route by a leading key; a guest is
    smaller than the rows at home and routes by one; guests are not paired.
    """

    def pairs_of(points, c):
        component, shard, cross, home, lead = c["component"], c["shard"], c["cross"][0], c["home"], c["lead"]
        size = points.sum(axis=1, dtype=np.int64)

        def allowed(i, j):
            smaller_leads = np.where(size[i] == size[j], lead[i] | lead[j], np.where(size[i] < size[j], lead[i], lead[j]))
            return (component[i] != component[j]) & (home[i] | home[j]) & smaller_leads & (not cross or (shard[i] != shard[j]))

        if len(points) <= LEAF:
            for d in range(1, len(points)):
                i = np.arange(len(points) - d)
                i = i[allowed(i, i + d)]
                shared = np.minimum(points[i], points[i + d]).sum(axis=1, dtype=np.int64)
                i = i[shared >= overlap_needed(size[i], size[i + d], percent)]
                yield i, i + d
            return
        tree = CountRTree(points)
        for i in range(len(points)):
            near = tree.search(points[i], percent)
            near = near[near > i]
            near = near[allowed(np.full(len(near), i), near)]
            yield np.full(len(near), i), near

    names = ("key", "band", "cell", "class", "component", "shard", "cross", "home", "lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _then_none(batches):
            if batch is not None:
                rest = batch if rest is None else pa.concat_batches([rest, batch])
            if rest is None or not len(rest):
                continue
            columns = {name: rest.column(name).to_numpy(zero_copy_only=False) for name in names}
            new = np.zeros(len(rest) - 1, dtype=bool)
            for name in ("key", "band", "cell"):
                new |= columns[name][1:] != columns[name][:-1]
            starts = np.flatnonzero(np.concatenate([[True], new]))
            ends = np.append(starts[1:], len(rest))
            if batch is not None:            # the last run may go on in the next batch
                starts, ends, cut = starts[:-1], ends[:-1], int(starts[-1])
            else:
                cut = len(rest)
            vectors = rest.column("vector").slice(0, cut).to_pylist()
            left, right = [], []
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s > 1:
                    groups = 2 * min(len(v) for v in vectors[s:e])
                    points = np.stack([fold(v, groups) for v in vectors[s:e]])
                    for i, j in pairs_of(points, {name: columns[name][s:e] for name in names}):
                        left.append(i + s)
                        right.append(j + s)
            if left:
                a, b = columns["class"][np.concatenate(left)], columns["class"][np.concatenate(right)]
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])
            rest = rest.slice(cut)

    return run


def _then_none(items):
    yield from items
    yield None


def _contested(routed: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes in different components that share a routing key and that the trees allow."""
    own = routed.select("class", "n", F.explode(F.arrays_zip("keys", "lead")).alias("key")).join(
        known.withColumnsRenamed({"node": "class"}), "class", "left")
    # sizes of one band differ by less than the similarity allows, so similar sets are in one band or in two neighbours
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    rows = own.select(F.col("key.keys").alias("key"), F.col("key.lead").alias("lead"), "class",
                      F.coalesce("component", "class").alias("component"), band.alias("own_band"))
    bands = F.when(F.col("lead"), F.array(F.col("own_band"), F.col("own_band") + 1)).otherwise(F.array("own_band"))
    rows = rows.withColumn("band", F.explode(bands)).withColumn("home", F.col("band") == F.col("own_band")).drop("own_band")
    trees = rows.groupBy("key", "band").agg(
        F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.max("home").alias("at_home"), F.max("lead").alias("led"))
    trees = trees.where("lo != hi and at_home and led").select(
        "key", "band", F.ceil(F.col("m") / SHARD).cast("int").alias("shards"))
    rows = rows.join(trees, ["key", "band"]).withColumn("shard", F.pmod("class", F.col("shards")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    rows = rows.select("key", "band", (F.least("shard", "other") * F.col("shards") + F.greatest("shard", "other")).alias("cell"),
                       "class", "component", "shard", (F.col("shard") != F.col("other")).alias("cross"), "home", "lead")
    rows = rows.join(routed.select("class", "vector"), "class").select(
        "key", "band", "cell", "class", "component", "shard", "cross", "home", "lead", "vector")
    n = int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key", "band", "cell").sortWithinPartitions("key", "band", "cell", "class")
    return rows.mapInArrow(lean(_search_runs(percent)), "a long, b long").distinct()


@written("components")
def similarity_components(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(profile(texts, width, percent), "ngram-profile")
    members = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("doc_id"))

    by_key = rows.where(F.col("class").isNotNull()).select("class", F.explode("keys").alias("key")).groupBy("key")
    keys = by_key.agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("key")
    keys = materialise(keys, "shared-keys")
    routed = materialise(_routed(rows, bitmap(keys), percent), "routed")

    # round 1: against the most typical class of each key: the one with the largest share of shared keys
    spread = routed.select("class", "typical", F.explode("keys").alias("key"))
    hubs = spread.groupBy("key").agg(F.max(F.struct("typical", "class")).alias("hub"), F.count("*").alias("m"))
    hubs = hubs.where("m > 1").select("key", F.col("hub.class").alias("hub"))
    stars = spread.join(hubs, "key").where("class != hub").select(
        F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()
    first = _verified(_bounded(stars, routed, percent), texts, members, width, percent)
    known = components(first)
    # round 2: what may still link different components
    second = _verified(_bounded(_contested(routed, known, percent), routed, percent), texts, members, width, percent)
    known = components(first.unionByName(second))

    grouped = members.join(known.withColumnsRenamed({"node": "class"}), "class", "left")
    grouped = grouped.select("class", "doc_id", F.coalesce("component", "class").alias("component"))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = grouped.join(least, "component").select("class", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "class").join(of_class, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
