"""Numeric helpers.

``round_to`` scales, rounds half away from zero and scales back, all in
double precision.  Spark's ``round`` on a double rounds the *decimal string*
of the value (so 1.23445 -> 1.2345), while Python and most SQL engines work
on the binary value (1.23445 is 1.2344499... -> 1.2344); scaling first keeps
the binary behaviour for the reports' 1-4 digit roundings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_to(c, digits: int) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.round(col.cast("double") * F.lit(scale), 0) / F.lit(scale)


def with_ordered_bits(df: DataFrame, c: str, out: str) -> DataFrame:
    """Adds a long in the order of a number's double value: the IEEE bits, negated for negative numbers.

    Zero of either sign is 0, infinities lie beyond all numbers, and NaN comes
    last, as Spark sorts it.  Built from exact operations: dividing by a power
    of two and scaling a mantissa lose nothing.  Each step is a column of its
    own, so that the generated code computes it once and stays small.
    """
    x, size, exponent, unit = (F.col(c).cast("double"), F.col("_size"), F.col("_exponent"), F.lit(2 ** 52))
    steps = (df.withColumn("_size", F.abs(x))
             .withColumn("_exponent", F.floor(F.log2(size)).cast("double"))       # may be one off next to a power of two
             .withColumn("_mantissa", size / F.pow(F.lit(2.0), exponent))
             .withColumn("_exponent", exponent + F.when(F.col("_mantissa") >= 2, 1).when(F.col("_mantissa") < 1, -1).otherwise(0))
             .withColumn("_mantissa", size / F.pow(F.lit(2.0), exponent) - 1))
    bits = (F.when(size == 0, F.lit(0).cast("bigint"))
            .when(F.isnan(size), F.lit(2047).cast("bigint") * unit + 1)
            .when(size == float("inf"), F.lit(2047).cast("bigint") * unit)
            .when(size < 2.0 ** -1022, (size / F.lit(5e-324)).cast("bigint"))
            .otherwise((exponent.cast("bigint") + 1023) * unit + (F.col("_mantissa") * 2.0 ** 52).cast("bigint")))
    return (steps.withColumn(out, bits).withColumn(out, F.when(x < 0, -F.col(out)).otherwise(F.col(out)))
            .drop("_size", "_exponent", "_mantissa"))
