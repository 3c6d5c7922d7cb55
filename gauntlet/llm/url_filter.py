"""URL filter: a broadcast trie over reversed host labels and path segments, longest match wins.

Rules are written ``host`` + ``path`` (``example.com/en/``).  A rule fits its
host and all subdomains of it when the path of the url starts with the path
of the rule.  Of the rules that fit, the one with most host labels wins, then
the one with the longest path; a rule listed as both allow and block blocks.

The trie is packed (sorted edges in flat arrays, a few bytes a node besides
the labels) and broadcast if it takes ``MAX_TRIE_BYTES`` at most.  Longer rule
lists are joined: each distinct url is looked up under its host suffixes and
those of its path's beginnings that are as long as some rule's path.  Both
ways give the same rows.

Cases: a null url or one without ``://`` has an empty host and path; no rule
fits an empty host, so it gets the default verdict and a null rule.  Repeated
rows are judged each.  An empty table gives an empty result.  Only the id and
url columns are read, so other columns cannot clash with the result's.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TRIE_BYTES = 64 << 20   # of the packed trie; longer rule lists are joined
HOST, SEGMENT, PREFIX = b"h", b"s", b"p"   # kinds of edges, before their labels


class UrlTrie:
    """Host labels from the top-level domain down, then path segments; node 0 is the root.

    An edge is a host label, a whole path segment with its slash, or the
    unfinished last segment of a rule, which fits all segments that it begins.
    The edges of a node are neighbours and sorted by label, edge ``e`` leads to
    node ``e + 1``, so the trie is a text of all labels and three numbers a
    node: where its label ends, where its edges begin, and its rule.
    """

    def __init__(self, allow: Sequence[str] = (), block: Sequence[str] = ()):
        listed = sorted((_edges(rule), action, rule) for action, rules in (("allow", allow), ("block", block))
                        for rule in rules)                          # block last: it wins a tie
        parents, labels, rules, path, at = [], [], {}, (), []       # nodes in the order of a walk downwards
        for edges, action, rule in listed:
            shared = 0
            while shared < min(len(edges), len(path)) and edges[shared] == path[shared]:
                shared += 1
            del at[shared:]
            for label in edges[shared:]:
                parents.append(at[-1] if at else 0)
                labels.append(label)
                at.append(len(labels))
            path, rules[len(labels) if not at else at[-1]] = edges, (action, rule)
        # the walk meets a node's edges in the order of their labels; nodes are numbered anew level by level
        parents = np.array([-1, *parents], np.int64)
        number, level = np.zeros(len(parents), np.int64), np.zeros(len(parents), np.int64)
        for node in range(1, len(parents)):
            level[node] = level[parents[node]] + 1
        done, order = 1, [np.zeros(1, np.int64)]
        for depth in range(1, int(level.max()) + 1):
            nodes = np.flatnonzero(level == depth)
            nodes = nodes[np.argsort(number[parents[nodes]], kind="stable")]
            number[nodes] = np.arange(done, done + len(nodes))
            done += len(nodes)
            order.append(nodes)
        order = np.concatenate(order)
        texts = [labels[node - 1] for node in order[1:].tolist()]
        self.labels, self.ends = b"".join(texts), np.cumsum([0, *map(len, texts)])
        self.edges = np.searchsorted(number[parents[order[1:]]], np.arange(done + 1)).astype(np.int32)
        self.rule = np.full(done, -1, np.int32)
        kept = sorted((int(number[node]), action, rule) for node, (action, rule) in rules.items())
        self.rule[[node for node, _, _ in kept]] = np.arange(len(kept))
        texts = [rule.encode() for _, _, rule in kept]
        self.rules, self.rule_ends = b"".join(texts), np.cumsum([0, *map(len, texts)])
        self.blocks = np.array([action == "block" for _, action, _ in kept], dtype=bool)

    @property
    def nbytes(self) -> int:
        return (len(self.labels) + len(self.rules) + self.ends.nbytes + self.edges.nbytes + self.rule.nbytes
                + self.rule_ends.nbytes + self.blocks.nbytes)

    def _label(self, edge: int) -> bytes:
        return self.labels[self.ends[edge]:self.ends[edge + 1]]

    def _child(self, node: int, label: bytes) -> int:
        """The node that the edge leads to, or 0."""
        lo, hi = int(self.edges[node]), int(self.edges[node + 1])
        at = bisect_left(range(hi), label, lo, hi, key=self._label)
        return at + 1 if at < hi and self._label(at) == label else 0

    def _prefix(self, node: int, segment: bytes) -> int:
        """The node of the longest unfinished segment that the segment begins with, or 0."""
        lo, hi, sought = int(self.edges[node]), int(self.edges[node + 1]), PREFIX + segment
        while lo < hi and len(sought) > 1:
            at = bisect_right(range(hi), sought, lo, hi, key=self._label) - 1
            if at < lo:
                return 0
            label = self._label(at)
            if sought.startswith(label):
                return at + 1
            shared = 0
            while shared < min(len(label), len(sought)) and label[shared] == sought[shared]:
                shared += 1
            sought, hi = sought[:shared], at      # whatever fits begins both, so it is no longer than that
        return 0

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, action) of the longest match, or None."""
        best, node, segments = -1, 0, [s.encode() for s in _segments(path)]
        for label in reversed(host.split(".") if host else []):
            node = self._child(node, HOST + label.encode())
            if not node:
                break
            found = self._longest(node, segments)
            best = found if found >= 0 else best
        if best < 0:
            return None
        rule = self.rules[self.rule_ends[best]:self.rule_ends[best + 1]].decode()
        return rule, "block" if self.blocks[best] else "allow"

    def _longest(self, node: int, segments: list[bytes]) -> int:
        best = int(self.rule[node])
        for segment in segments:
            prefix = self._prefix(node, segment)
            best = int(self.rule[prefix]) if prefix else best
            node = self._child(node, SEGMENT + segment)
            if not node:
                break
            best = int(self.rule[node]) if self.rule[node] >= 0 else best
        return best


def _segments(path: str) -> list[str]:
    """``/en/ar`` -> ``/``, ``en/``, ``ar``; the last is unfinished and may be empty."""
    parts = path.split("/")
    return [p + "/" for p in parts[:-1]] + parts[-1:]


def _edges(rule: str) -> tuple[bytes, ...]:
    """A rule's way from the root."""
    host, slash, rest = rule.partition("/")
    *whole, last = _segments(slash + rest)
    way = [HOST + label.encode() for label in reversed(_ascii_lower(host).split("."))]
    return (*way, *(SEGMENT + s.encode() for s in whole), *([PREFIX + last.encode()] if last else []))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


def _ascii_lower(host: str) -> str:
    return host.translate(_FOLD)


def url_parts(url) -> tuple:
    """Host (A-Z lower-cased) and path columns of a url column."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_table(spark: SparkSession, allow: Sequence[str], block: Sequence[str]) -> DataFrame:
    rules = [(r, "allow") for r in allow] + [(r, "block") for r in block]
    return spark.createDataFrame(rules, "rule string, action string")


def judge_parts_by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule and verdict of each distinct (host, path), by equijoins with the rules (rule, action).

    A url has a key for every suffix of its host and every beginning of its
    path that is as long as some rule's path; the driver gets those lengths
    only, each once.  Rules are unique by key before the join, so a key that
    many urls share is a skewed side of a join that AQE may split.
    """
    way = F.split("rule", "/", 2)
    keyed = rules.select("rule", "action", F.translate(way[0], UPPER, LOWER).alias("rule_host"),
                         F.expr("substr(rule, length(split(rule, '/', 2)[0]) + 1)").alias("rule_path"))
    best = F.struct((F.col("action") == "block").cast("int").alias("blocks"), "rule", "action")
    keyed = keyed.groupBy("rule_host", "rule_path").agg(F.max(best).alias("found"))
    lengths = sorted(r[0] for r in keyed.select(F.length("rule_path")).distinct().collect())
    labels = F.split("host", r"\.", -1)
    urls = parts.select("host", "path").where("host <> ''").distinct().withColumn("labels", labels)
    suffixes = urls.select("host", "path", F.explode(F.expr("sequence(1, size(labels))")).alias("n_labels"), "labels")
    suffixes = suffixes.select("host", "path", "n_labels", F.expr(
        "array_join(slice(labels, size(labels) - n_labels + 1, n_labels), '.')").alias("rule_host"))
    fitting: Column = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = suffixes.join(keyed.select("rule_host").distinct(), "rule_host", "left_semi").withColumn(
        "n_path", F.explode(fitting)).withColumn("rule_path", F.expr("substr(path, 1, n_path)"))
    found = keys.join(keyed, ["rule_host", "rule_path"]).groupBy("host", "path").agg(
        F.max(F.struct("n_labels", "n_path", "found.blocks", "found.rule", "found.action")).alias("won"))
    return found.select("host", "path", "won.rule", F.col("won.action").alias("verdict"))


def judge_urls(pages: DataFrame, allow: Sequence[str], block: Sequence[str], *, id_col: str = "page_id",
               url_col: str = "url", default: str = "allow", max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits) and verdict."""
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rules = UrlTrie(allow, block)
    if rules.nbytes > max_trie_bytes:
        found = judge_parts_by_join(parts, rule_table(pages.sparkSession, allow, block))
        return parts.join(found, ["host", "path"], "left").select(
            id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    trie = pages.sparkSession.sparkContext.broadcast(rules)

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        rules = trie.value
        for hosts, paths in batches:
            found = [rules.match(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    return parts.withColumn("judged", judge("host", "path")).select(
        id_col, "host", "path", "judged.rule", "judged.verdict")
