"""Report documents as VARIANT values: metric paths and histograms, whatever their labels hold.

A document column is JSON text (as the sinks write it).  It is parsed once per
row; paths are literals, so each is compiled once per plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant_path(steps: Sequence[str]) -> str:
    """The path of a nested key.  A key may hold dots, commas and equal signs, but not both kinds of quotes or a ``?``."""
    out = "$"
    for step in steps:
        quote = '"' if "'" in step else "'"
        if not step or quote in step or "?" in step:
            raise ValueError(f"no variant path can name the key {step!r}; use histogram_entries")
        out += f"[{quote}{step}{quote}]"
    return out


def _parsed(docs: DataFrame, document: str) -> DataFrame:
    return docs.withColumn("_variant", F.try_parse_json(F.col(document)))


def metric_values(docs: DataFrame, keys: Sequence[str], metrics: Sequence[str], document: str = "document") -> DataFrame:
    """(keys, metric, value, detail) for every document and dotted metric.

    ``value`` is the number at the path; ``detail`` the JSON text (keys sorted)
    where the path leads to an object.  A missing path, a null, an unreadable
    document or a null one gives null for both, not an error.
    """
    def entry(metric: str) -> Column:
        path = variant_path(metric.split("."))
        at = lambda kind: F.try_variant_get("_variant", path, kind)
        return F.struct(F.lit(metric).alias("metric"), at("double").alias("value"),
                        F.when(at("map<string,variant>").isNotNull(), F.to_json(at("variant"))).alias("detail"))

    return (_parsed(docs, document).select(*keys, F.explode(F.array(*[entry(m) for m in metrics])).alias("_m"))
            .select(*keys, "_m.*"))


def histogram_entries(docs: DataFrame, keys: Sequence[str], metric: str, document: str = "document") -> DataFrame:
    """(keys, label, n) of the histogram object at a dotted metric; no row where there is none."""
    path = variant_path(metric.split("."))
    objects = (_parsed(docs, document).select(*keys, F.try_variant_get("_variant", path, "variant").alias("_object"))
               .where(F.try_variant_get("_object", "$", "map<string,variant>").isNotNull()))
    entries = objects.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("_object").outer()))
    return entries.select(*keys, F.col("key").alias("label"), F.try_variant_get("value", "$", "bigint").alias("n"))
