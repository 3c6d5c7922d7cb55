"""Merkle manifest of a dataset: sibling-shift self-joins build the trees, one pass down gives the proofs.

Rows become leaves (sha256 over their columns, each with its byte count in front), leaves of one group become a
tree, and the groups' roots become the tree of the whole.  Nodes are rows (tree, pos): at every level a node is
joined with the nodes at its siblings' positions, which are computed from its own (``pos XOR 1`` in a binary tree,
slot offsets otherwise), and the rows in slot zero emit the parents.  A level is written to the shared folder before
the next one reads it.  A last run may hold fewer nodes, even one; its parent is the hash of what there is.

Proofs go down: a node's path is the siblings of its own level followed by its parent's path, so the level above the
leaves moves one path per run and the levels over it ever fewer.  Everything is DataFrame work inside the JVM.

Positions come from a range partitioning over (group, order, leaf, row), numbered within ranges and shifted by the
counts of the ranges before, so that a group which holds most rows is still dealt over all tasks.

Cases: a null in any column is the leaf's ``-``; a null id sorts before all others and is never tampered with; a
null group is a group of its own, before the others.  Rows that repeat an id are leaves of their own, in the order
of their leaf digests; equal rows have equal leaves, and whichever comes first has the same root.  An empty text
counts 0 bytes; texts are hashed whole and never shuffled.  A group of one row has its leaf as root.  An empty table
gives an empty result.  Columns beyond those of the leaf are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gauntlet.llm.common import materialise

LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of at most so many nodes are one task's work; the count is known before the level is read.
ONE_TASK_NODES = 20_000
PATH = "array<struct<before:binary,after:binary>>"


def digest(value: Column) -> Column:
    """sha256 of a string, as 32 bytes."""
    return F.unhex(F.sha2(value.cast("binary"), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_digest(columns: Iterable[Column]) -> Column:
    """The leaf of one row: each column as ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
             for c in (c.cast("string") for c in columns)]
    return digest(F.concat(*parts))


def tree_positions(leaves: DataFrame, tree: str, order: Sequence[Column]) -> DataFrame:
    """The rows with ``pos``, their place in their tree from 0, and ``size``, the tree's number of leaves.

    ``leaves`` is a written table.  ``order`` decides within a tree; rows equal in it keep any order.  No task holds
    a whole tree: ranges are cut through a tree, and through equal rows too, by a row number as the last sort key.
    """
    keys = [F.col(tree).asc_nulls_first(), *order, F.col("_at").asc()]
    ranged = leaves.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*keys)
    rows = materialise(ranged.sortWithinPartitions(*keys).drop("_at").withColumn("_row", F.monotonically_increasing_id()),
                       "merkle-order").withColumn("_part", F.shiftright("_row", 33))
    parts = rows.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_own")).agg(
        F.min("_row").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_tree")                 # a row for each range that the tree has a part in
    before = whole.orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_tree", "_own", "_first", F.sum("_n").over(whole).alias("size"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = rows.join(parts, (F.col("_part") == F.col("_own")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return joined.withColumn("pos", F.col("_before") + F.col("_row") - F.col("_first")).drop(
        "_row", "_part", "_own", "_first", "_before", "_tree")


def sibling_index(pos: str, offset: int, arity: int) -> str:
    """SQL for the position ``offset`` slots further in the run, around its end."""
    if arity == 2:
        return f"({pos} ^ 1)"
    return f"({pos} - {pos} % {arity} + ({pos} + {offset}) % {arity})"


def with_siblings(nodes: DataFrame, tree: str, arity: int) -> DataFrame:
    """Every node joined with its siblings: ``before`` and ``after`` are their digests in order, one after the other.

    One equijoin per slot offset.  Merge joins: both sides are as large as the level.
    """
    offsets = range(1, arity)
    joins = " ".join(f"LEFT JOIN {{nodes}} s{k} ON s{k}.`{tree}` <=> n.`{tree}` AND s{k}.pos = {sibling_index('n.pos', k, arity)}"
                     for k in offsets)

    def run(side: str) -> str:
        """The siblings in the slots on one side of a node's own; slot j is the node's slot plus the offset."""
        slots = (f"CASE {' '.join(f'WHEN (n.pos + {k}) % {arity} = {j} THEN s{k}.hash' for k in offsets)} END" for j in range(arity))
        held = ", ".join(f"coalesce(if({j} {side} n.pos % {arity}, {slot}, X''), X'')" for j, slot in enumerate(slots))
        return f"concat({held})"

    hint = ", ".join(f"s{k}" for k in offsets)
    return nodes.sparkSession.sql(
        f"SELECT /*+ MERGE({hint}) */ n.*, n.pos % {arity} AS slot, {run('<')} AS before, {run('>')} AS after FROM {{nodes}} n {joins}",
        nodes=nodes)


def _dealt(nodes: DataFrame, count: int) -> DataFrame:
    """A level of few nodes in one task, others as they are."""
    return nodes.coalesce(1) if count <= ONE_TASK_NODES else nodes


def build_levels(leaves: DataFrame, tree: str, arity: int) -> list[tuple[DataFrame, int]]:
    """The trees' levels from the leaves (tree, pos, size, hash, ...) up, each with siblings and a bound of its rows.

    Every level is a written table.  A tree leaves the levels once it has one node, its root; there ``size`` is 1.
    """
    sizes = leaves.where("pos = 0").agg(F.max("size"), F.sum("size"), F.count("*")).first()
    largest, count, trees = (int(n or 0) for n in sizes)
    levels, nodes = [], leaves
    while largest:
        level = materialise(with_siblings(_dealt(nodes, count), tree, arity), f"merkle-level-{len(levels)}")
        levels.append((level, count))
        if largest == 1:
            break
        nodes = level.where("slot = 0 AND size > 1").selectExpr(
            f"`{tree}`", f"pos DIV {arity} AS pos", f"(size + {arity - 1}) DIV {arity} AS size",
            "unhex(sha2(concat(lower(hex(before)), lower(hex(hash)), lower(hex(after))), 256)) AS hash")
        largest, count = -(-largest // arity), count // arity + trees
    return levels


def roots(levels: list[tuple[DataFrame, int]], tree: str) -> DataFrame:
    """(tree, hash) of every tree."""
    return reduce(DataFrame.unionByName, [level.where("size = 1").select(tree, "hash") for level, _ in levels])


def paths_down(levels: list[tuple[DataFrame, int]], tree: str, arity: int, top: DataFrame) -> DataFrame:
    """The leaves with ``path``: the siblings of each level up to the tree's root, then the path of ``top``.

    ``top`` has a row per tree: the tree, ``path`` and columns that all leaves of the tree get.
    """
    carried = "".join(f", p.`{c}`" for c in top.columns if c not in (tree, "path"))
    above = None
    for k in reversed(range(len(levels))):
        level, count = levels[k]
        own = [c for c in level.columns if c not in ("before", "after", "slot")] if not k else [tree, "pos"]
        columns = ", ".join(f"n.`{c}`" for c in own)
        query = (f"SELECT /*+ MERGE(p) */ {columns}, p.path{carried} FROM {{level}} n JOIN {{top}} p "
                 f"ON n.`{tree}` <=> p.`{tree}` WHERE n.size = 1")
        if above is not None:
            query += (f" UNION ALL SELECT /*+ MERGE(p) */ {columns}, concat(array(struct(n.before, n.after)), p.path){carried} "
                      f"FROM {{level}} n JOIN {{above}} p ON n.`{tree}` <=> p.`{tree}` AND n.pos DIV {arity} = p.pos WHERE n.size > 1")
        sides = {"level": _dealt(level, count), "top": _dealt(top, count)}
        if above is not None:
            sides["above"] = _dealt(above, count)
        out = level.sparkSession.sql(query, **sides)
        if k:
            above = materialise(_dealt(out, count), f"merkle-paths-{k}")
    return out


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a node's digest and its path."""
    return F.aggregate(path, start, lambda own, run: digest(F.concat(hexed(run["before"]), hexed(own), hexed(run["after"]))))


def proof_digest(path: Column) -> Column:
    """sha256 over the siblings of a path, in order."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda run: hexed(F.concat(run["before"], run["after"])))).cast("binary"), 256)


def manifest(docs: DataFrame, *, group: str = "lang", order: str = "doc_id", columns: Sequence[str] = LEAF_COLUMNS,
             altered: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """One row per document: order column, group column, leaf, subroot, root, path, proof_sha256, folded_root, verified.

    ``altered`` replaces columns before the check, as someone who tampered with the data would have: the leaf that is
    folded along the original path then comes from the altered row.  Digests are hex text, ``path`` an array of
    (before, after) bytes from the leaf's level up.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    original = {c: F.col(c) for c in columns}
    changed = original | (altered or {})
    leaves = materialise(docs.select(
        F.col(group).cast("string").alias("group"), F.col(order).alias("order"),
        leaf_digest(original.values()).alias("hash"), leaf_digest([changed[c] for c in columns]).alias("checked")),
        "merkle-leaves")
    placed = materialise(tree_positions(leaves, "group", [F.col("order").asc_nulls_first(), F.col("hash").asc()]),
                         "merkle-positions")
    levels = build_levels(placed, "group", arity)
    if not levels:
        return _result(placed.withColumns({"subroot": F.lit(b""), "root": F.lit(b""), "path": F.array().cast(PATH)}), group, order)
    subroots = materialise(roots(levels, "group").withColumn("whole", F.lit(0)), "merkle-subroots")
    over = build_levels(materialise(tree_positions(subroots, "whole", [F.col("group").asc_nulls_first()]), "merkle-top-leaves"),
                        "whole", arity)
    root = roots(over, "whole").select("whole", F.col("hash").alias("root"), F.array().cast(PATH).alias("path"))
    top = materialise(paths_down(over, "whole", arity, root).select(
        "group", F.col("hash").alias("subroot"), "root", "path"), "merkle-top")
    return _result(paths_down(levels, "group", arity, top), group, order)


def _result(leaves: DataFrame, group: str, order: str) -> DataFrame:
    folded = fold(F.col("checked"), F.col("path"))
    out = leaves.select(F.col("order").alias(order), F.col("group").alias(group), hexed(F.col("hash")).alias("leaf"),
                        hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), "path",
                        proof_digest(F.col("path")).alias("proof_sha256"), hexed(folded).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, checked against a copy in which some rows count one character more."""
    own = F.col("n_chars").cast("decimal(20,0)")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(touched, own + 1).otherwise(own).cast("string")
    found = manifest(docs, altered={"n_chars": changed})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
