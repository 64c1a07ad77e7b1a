"""Statistics and leakage-safe validation folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_LAGS = 120


def hac_mean(series: DataFrame, lags: int, correct: bool = False) -> DataFrame:
    """(series, n, mean, variance_mean, standard_error, t_statistic) with Bartlett weights, of (series, idx, value); null
    statistic at zero variance. idx orders the values. Each lag is a column of one window, so nothing is joined; series of
    no more than lags values are left out."""
    if not 0 <= lags <= MOST_LAGS:
        raise ValueError(f"lags must lie in 0..{MOST_LAGS}")
    part = Window.partitionBy("series")
    w = part.orderBy("idx")
    rows = series.withColumn("n", F.count("*").over(part)).filter(F.col("n") > lags).withColumn("u", F.col("value") - F.avg("value").over(part))
    weighted = F.col("u") * F.col("u")
    rows = rows.withColumns({f"u{k}": F.coalesce(F.lag("u", k).over(w), F.lit(0.0)) for k in range(1, lags + 1)})
    for k in range(1, lags + 1):
        weighted = weighted + 2 * (1 - k / (lags + 1)) * F.col("u") * F.col(f"u{k}")
    factor = F.col("n") / (F.col("n") - 1) if correct else F.lit(1.0)
    by = rows.groupBy("series", "n").agg(F.avg("value").alias("mean"), F.sum(weighted).alias("s"))
    out = by.withColumn("variance_mean", F.greatest(F.lit(0.0), F.col("s") / (F.col("n") * F.col("n")) * factor)).withColumn("standard_error", F.sqrt("variance_mean"))
    return out.select("series", "n", "mean", "variance_mean", "standard_error", F.when(F.col("standard_error") > 0, F.col("mean") / F.col("standard_error")).alias("t_statistic"))


def walk_forward(labels: DataFrame, initial: int, test: int) -> DataFrame:
    """(series, fold, idx, role) of labels (series, idx from 0, start, available): blocks of `test` after the first
    `initial`; of the earlier labels those available before the block starts train, the others are purged. A last part of
    a block is kept; folds go on to the last label."""
    n = labels.groupBy("series").agg((F.max("idx") + 1).alias("n"))
    folds = n.filter(F.col("n") > initial).select("series", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - initial - 1) / test).cast("int"))).alias("fold"))
    folds = folds.withColumn("first", (F.lit(initial) + F.col("fold") * test).cast("bigint"))
    starts = folds.join(labels.select("series", F.col("idx").cast("bigint").alias("first"), F.col("start").alias("test_start")), ["series", "first"])
    rows = labels.join(starts, "series").filter(F.col("idx") < F.col("first") + test)
    role = F.when(F.col("idx") >= F.col("first"), "test").when(F.col("available") < F.col("test_start"), "train").otherwise("purged")
    return rows.select("series", "fold", "idx", role.alias("role"))


def purged_fold(labels: DataFrame, first: int, last: int, embargo: int) -> DataFrame:
    """(series, idx, role) for the test block first..last of labels (series, idx, start, end): what overlaps the block's time
    is purged, what starts within embargo after it embargoed, the rest trains. start and end are numbers."""
    block = labels.filter(F.col("idx").between(first, last)).groupBy("series").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    role = (
        F.when(F.col("idx").between(first, last), "test").when((F.col("start") <= F.col("b")) & (F.col("end") >= F.col("a")), "purged")
        .when((F.col("start") > F.col("b")) & (F.col("start") <= F.col("b") + embargo), "embargoed").otherwise("train")
    )
    return labels.join(block, "series").select("series", "idx", role.alias("role"))


def gate(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: passes before and after on the same cases, and whether a twentieth or more of them was lost."""
    both = before.select("case_id", F.col("passed").alias("b")).join(after.select("case_id", F.col("passed").alias("a")), "case_id")
    out = both.agg(F.count("*").alias("cases"), F.sum(F.col("b").cast("int")).alias("passed_before"), F.sum(F.col("a").cast("int")).alias("passed_after"))
    return out.withColumn("regressed", (F.col("passed_before") - F.col("passed_after")) * 20 >= F.col("passed_before"))
