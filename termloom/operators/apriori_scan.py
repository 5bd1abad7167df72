"""Level-wise counting: a window counts if both windows inside it were frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import windows
from ..sources.store import Levels
from .encode import frequent_runs


def apriori_scan_ngrams(frequent: DataFrame, min_support: int, max_length: int) -> DataFrame:
    """``gram, support``. Level k scans the runs again; it ends with an empty level or at ``max_length``."""
    levels = Levels(frequent.sparkSession, "apriori-scan")
    runs = levels.keep(frequent_runs(frequent).select("tids"), "runs")
    found: list[DataFrame] = []
    k = 1
    while not max_length or k <= max_length:
        grams = runs.where(F.size("tids") >= k).select(F.explode(windows(F.col("tids"), k)).alias("gram"))
        if k > 2:
            last = found[-1].select("gram")
            for start in (1, 2):
                part = last.withColumnRenamed("gram", "part")
                grams = grams.join(part, F.slice("gram", start, k - 1) == F.col("part"), "left_semi")
        level = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
        level = levels.keep(level, f"level-{k}")
        if not level.limit(1).count():
            break
        found.append(level)
        k += 1
    return _union(found, frequent)


def _union(found: list[DataFrame], frequent: DataFrame) -> DataFrame:
    if not found:
        return frequent.sparkSession.createDataFrame([], "gram array<int>, support long")
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out
