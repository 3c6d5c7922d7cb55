"""Aggregates: exact order statistics at scale, ratio statistics, telemetry, histograms.

Order statistics (nearest-rank percentile, upper median) never sort a whole
group in one task: values are first pre-aggregated to (key, value, count) --
a partial aggregation that runs map-side -- and the value at a rank is then
found by radix selection over the leading bits of the ordered value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gauntlet.functions.num import round_to, with_ordered_bits

#: Bits of each digit of the radix selection, from the highest; a window sees 2**22 rows of a group at most.
RADIX_DIGITS = (21, 21, 22)
#: Groups of at most so many distinct values are walked in one window.
WALKED_VALUES = 10_000


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, "callable"]) -> DataFrame:
    """Value at 0-based rank ``ranks[name](n)`` for each group; also returns ``n``.

    ``ranks`` maps an output name to a function of the group size Column ``n``
    giving the 0-based rank to pick.  Values are counted map-side first, so a
    hot group is dealt by value.  A group of few distinct values is then walked
    in their order; a larger one is narrowed by radix selection, so no task
    ever sees more than a bounded number of a group's rows.  Nothing is
    checkpointed, and building the plan runs no job.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("_values"))
    sized = counted.join(sizes, keys)
    few = F.col("_values") <= WALKED_VALUES
    return _walk(sized.where(few), keys, value, ranks).unionByName(_radix_select(sized.where(~few), keys, value, ranks))


def _walk(sized: DataFrame, keys: list[str], value: str, ranks: dict) -> DataFrame:
    up_to = F.sum("_c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    at = [F.min(F.when(F.col("_up_to") > rank(F.col("n")), F.col(value))).alias(name) for name, rank in ranks.items()]
    return sized.withColumn("_up_to", up_to).groupBy(*keys).agg(F.max("n").alias("n"), *at)


def _radix_select(sized: DataFrame, keys: list[str], value: str, ranks: dict) -> DataFrame:
    """Ranks narrowed digit by digit: counts by the leading bits of the ordered value tell which bucket holds a rank,
    and only that bucket's values are counted by the next bits."""
    wanted = F.array(*[F.struct(F.lit(name).alias("_name"), rank(F.col("n")).cast("bigint").alias("_rank"))
                       for name, rank in ranks.items()])
    counted = with_ordered_bits(sized.select(*keys, value, "_c", "n"), value, "_bits")
    shift, digits, chosen = 64, [], None
    for level, width in enumerate(RADIX_DIGITS):
        shift -= width
        digits.append(f"_d{level}")
        # the highest digit keeps the sign
        digit = F.shiftright("_bits", shift) if not level else F.shiftright("_bits", shift).bitwiseAND((1 << width) - 1)
        # not null, so that a join on it pushes no filter down: all digits then read one exchange of the counts
        counted = counted.withColumn(digits[-1], F.coalesce(digit, F.lit(0)))
        group = [*keys, "_name"] if level else keys
        inside = counted if chosen is None else counted.join(chosen, [*keys, *digits[:-1]])
        carried = [F.max("_rank").alias("_rank")] if level else []
        # one value per lowest bucket: the bits are the whole value
        counts = inside.groupBy(*group, *digits).agg(F.sum("_c").alias("_s"), F.max(value).alias(value), F.max("n").alias("n"), *carried)
        up_to = Window.partitionBy(*group).orderBy(digits[-1]).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_before", F.sum("_s").over(up_to) - F.col("_s"))
        if not level:
            counts = counts.withColumn("_w", F.explode(wanted)).select("*", "_w.*").drop("_w")
        counts = counts.where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_s")))
        chosen = counts.withColumn("_rank", F.col("_rank") - F.col("_before")).drop("_s", "_before", *([] if not shift else [value, "n"]))
    return chosen.groupBy(*keys).agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in ranks])


def nearest_rank(p: float):
    """D6 rank rule: clamp(round_half_even(p/100 * (n-1)), 0, n-1)."""
    def rank(n: Column) -> Column:
        k = F.bround(F.lit(p) / 100.0 * (n - 1), 0).cast("bigint")
        return F.greatest(F.lit(0), F.least(n - 1, k))
    return rank


def upper_middle(n: Column) -> Column:
    """sorted[n // 2]."""
    return F.floor(n / 2).cast("bigint")


def latency_percentiles(df: DataFrame, keys: list[str], value: str, digits: int = 3) -> DataFrame:
    """Nearest-rank p50 / p95 per group, rounded; null when a group has no values."""
    # rounding keeps the order, and makes the distinct values to walk far fewer
    rounded = df.withColumn(value, round_to(value, digits))
    stats = order_statistics(rounded, keys, value, {"p50": nearest_rank(50), "p95": nearest_rank(95)})
    groups = df.select(*keys).distinct()
    return (groups.join(stats, keys, "left")
            .select(*keys, F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
                    round_to("p50", digits).alias("p50"), round_to("p95", digits).alias("p95")))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """sorted[n // 2] per group."""
    return (order_statistics(df, keys, value, {"upper_median": upper_middle})
            .select(*keys, F.col("n").cast("bigint").alias("n"), "upper_median"))


def ratio_stats(df: DataFrame, keys: list[str], value: str, groups: DataFrame | None = None) -> DataFrame:
    """N, geomean, median, min, max, % > 1.0 (4/4/4/4/2 digits); empty -> n=0, nulls.

    Geomean is over positive ratios only; ``n_nonpositive`` counts the others
    (log of 0 is undefined).
    """
    v = F.col(value)
    out = (df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_kernels_measured"),
        F.exp(F.avg(F.when(v > 0, F.ln(v)))).alias("_geo"),
        F.min(v).alias("_min"), F.max(v).alias("_max"),
        F.count_if(v > 1.0).alias("_faster"),
        F.count_if(v <= 0).alias("n_nonpositive")))
    # the median is the mean of the two middle ranks, so that no task holds a group's distinct values
    middle = order_statistics(df, keys, value, {"_lower": lambda n: F.floor((n - 1) / 2), "_upper": lambda n: F.floor(n / 2)})
    out = out.join(middle.select(*keys, ((F.col("_lower") + F.col("_upper")) / 2).alias("_median")), keys)
    if groups is not None:
        out = groups.join(out, keys, "left")
    n = F.coalesce(F.col("n_kernels_measured"), F.lit(0))
    return out.select(
        *keys,
        n.cast("bigint").alias("n_kernels_measured"),
        round_to("_geo", 4).alias("geomean_speedup"),
        round_to("_median", 4).alias("median_speedup"),
        round_to("_min", 4).alias("min_speedup"),
        round_to("_max", 4).alias("max_speedup"),
        round_to(F.try_divide(F.col("_faster") * 100.0, n), 2).alias("pct_faster_than_pytorch"),
        F.coalesce(F.col("n_nonpositive"), F.lit(0)).cast("bigint").alias("n_nonpositive"),
    )


def generation_telemetry(df: DataFrame, keys: list[str], latency="latency_s",
                         tokens="completion_tokens", finish="finish_reason") -> DataFrame:
    """Latency mean keeps 0.0 and drops null; token totals and mean skip null and 0."""
    t = F.nullif(F.col(tokens), F.lit(0))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"),
        round_to(F.avg(round_to(latency, 3)), 3).alias("latency_mean"),
        F.coalesce(F.sum(t), F.lit(0)).cast("bigint").alias("total_completion"),
        round_to(F.avg(t), 1).alias("mean_completion"),
        F.count_if(F.coalesce(F.col(finish), F.lit("")) == "length").alias("truncated_count"),
    )


def histogram_text(df: DataFrame, keys: list[str], label: str, name: str) -> DataFrame:
    """Map-valued histogram ``label -> count``, also serialised sorted by label."""
    counted = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    m = F.map_from_entries(F.collect_list(F.struct(F.col(label), F.col("_n"))))
    return (counted.groupBy(*keys).agg(m.alias(name))
            .withColumn(name + "_text", map_text(F.col(name))))


def map_text(m: Column) -> Column:
    """Flat, engine-neutral form of a map: ``k=v`` pairs sorted by key, comma-joined.

    A comma, equal sign or backslash of a key has a backslash before it, so ``text_map`` gets every map back.
    """
    entries = F.array_sort(F.map_entries(m))
    key = lambda e: F.regexp_replace(e["key"], r"([\\,=])", r"\\$1")
    return F.array_join(F.transform(entries, lambda e: F.concat(key(e), F.lit("="), e["value"].cast("string"))), ",")


def text_map(text: Column) -> Column:
    """The map of counts that ``map_text`` wrote; '' or null gives an empty one."""
    entry, text = F.lit(r"((?:[^\\,=]|\\.)*)=(-?\d+)(?:,|$)"), F.coalesce(text, F.lit(""))
    keys = F.transform(F.regexp_extract_all(text, entry, F.lit(1)), lambda k: F.regexp_replace(k, r"\\(.)", "$1"))
    counts = F.transform(F.regexp_extract_all(text, entry, F.lit(2)), lambda n: n.cast("bigint"))
    return F.map_from_arrays(keys, counts)
