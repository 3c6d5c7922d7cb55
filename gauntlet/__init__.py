"""gauntlet: Spark-native analytics for code-generation evaluation runs.

Replies, attempts, probe results, timings and source files arrive as tables;
every operator here is a DataFrame transformation or a Column expression.
"""

from gauntlet.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
