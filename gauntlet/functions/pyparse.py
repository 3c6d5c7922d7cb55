"""The one true UDF -- does a code string parse as Python?

Arrow-batched pandas UDF around ``ast.parse``.  Returns a status string:
``ok``, ``syntax`` (SyntaxError and its subclasses) or ``other`` (anything
else ``ast.parse`` raises, e.g. RecursionError / MemoryError on pathological
input).  Callers pass null for rows that need no parse: Spark evaluates a
Python UDF for every row, whatever condition stands around the call.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _status(code) -> str | None:
    if code is None:
        return None
    try:
        ast.parse(code)
        return "ok"
    except SyntaxError:
        return "syntax"
    except Exception:  # noqa: BLE001 - one bad row must not fail the task
        return "other"


@F.pandas_udf(StringType())
def python_parse_status(codes: pd.Series) -> pd.Series:
    return codes.map(_status)

