"""Validation of return series: fold diagnostics, full samples, and the checks that saved studies must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.stats import hac_mean, walk_forward

LEAST_MONTHS = 85


def fold_diagnostics(returns: DataFrame, initial: int, test: int, lags: int, correct: bool = False) -> DataFrame:
    """(series, fold, n, n_train, n_purged, mean, variance_mean, t_statistic, reason) of the test block of each walk-forward fold
    of returns (series, idx, start, available, value). Training rows are only counted, never strung together. reason is
    INSUFFICIENT_HAC_SAMPLE for blocks of fewer than two values or of no more than lags."""
    folds = walk_forward(returns, initial, test)
    counts = folds.groupBy("series", "fold").agg(*[F.count(F.when(F.col("role") == r, 1)).alias(n) for r, n in (("test", "n"), ("train", "n_train"), ("purged", "n_purged"))])
    blocks = folds.filter("role = 'test'").join(returns.select("series", "idx", "value"), ["series", "idx"]).withColumn("block", F.struct("series", "fold"))
    stats = hac_mean(blocks.select(F.col("block").alias("series"), "idx", "value"), lags, correct).filter("n >= 2")
    stats = stats.select("series.series", "series.fold", "mean", "variance_mean", "t_statistic", F.lit(True).alias("_enough"))
    out = counts.join(stats, ["series", "fold"], "left")
    return out.withColumn("reason", F.when(F.col("_enough").isNull(), "INSUFFICIENT_HAC_SAMPLE")).drop("_enough")


def validate_series(returns: DataFrame, statuses: DataFrame, initial: int, lags: int, correct: bool = False) -> DataFrame:
    """(series, n, mean, t_statistic, reason) of the full sample of each series in statuses (series, status): reason is
    EXPERIMENT_NOT_COMPLETED, INSUFFICIENT_HAC_SAMPLE or INSUFFICIENT_SPLIT_SAMPLE (too short for any fold, but with statistics)."""
    sizes = returns.groupBy("series").agg(F.count("*").alias("n"))
    full = hac_mean(returns, lags, correct).filter("n >= 2").select("series", "mean", "t_statistic", F.lit(True).alias("_enough"))
    out = statuses.join(sizes, "series", "left").join(full, "series", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    open_ = F.col("status") != "completed"
    reason = F.when(open_, "EXPERIMENT_NOT_COMPLETED").when(F.col("_enough").isNull(), "INSUFFICIENT_HAC_SAMPLE").when(F.col("n") <= initial, "INSUFFICIENT_SPLIT_SAMPLE")
    return out.select("series", "n", *[F.when(~open_, F.col(c)).alias(c) for c in ("mean", "t_statistic")], reason.alias("reason"))


def returns_of_closes(closes: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns (series, idx, at, value) of the series (series, at, nav) whose closes are the calendar's (at) exactly, and of the
    others (series, missing, extra)."""
    days = calendar.select("at").distinct()
    n = days.count()
    by = closes.join(days.withColumn("_there", F.lit(True)), "at", "left").groupBy("series").agg(F.count_distinct(F.when(F.col("_there"), F.col("at"))).alias("have"), F.count(F.when(F.col("_there").isNull(), 1)).alias("extra"))
    w = Window.partitionBy("series").orderBy("at")
    whole = closes.join(by.filter((F.col("have") == n) & (F.col("extra") == 0)).select("series"), "series", "left_semi")
    moved = whole.select("series", (F.row_number().over(w) - 2).alias("idx"), "at", (F.col("nav") / F.lag("nav").over(w) - 1).alias("value")).filter("idx >= 0")
    return moved, by.filter((F.col("have") != n) | (F.col("extra") > 0)).select("series", (F.lit(n) - F.col("have")).alias("missing"), "extra")


def too_short(monthly: DataFrame, least: int = LEAST_MONTHS) -> DataFrame:
    """Symbols (symbol, months) with fewer months than a study needs."""
    return monthly.groupBy("symbol").agg(F.count_distinct("month").alias("months")).filter(F.col("months") < least)


def aligned_intervals(returns: DataFrame, rates: DataFrame, known_by) -> DataFrame:
    """returns (series, start_at, end_at, ret) with the rate of exactly that interval and a reason where there is none that was
    known: risk_free_missing, risk_free_late or risk_free_ambiguous. rates has (start_at, end_at, available_at, rate); no other
    interval is taken in its place."""
    by = rates.groupBy("start_at", "end_at").agg(F.count_distinct("rate").alias("n"), F.max("rate").alias("rate"), F.min("available_at").alias("known"))
    out = returns.join(by, ["start_at", "end_at"], "left")
    reason = F.when(F.col("n").isNull(), "risk_free_missing").when(F.col("n") > 1, "risk_free_ambiguous").when(F.col("known").isNull() | (F.col("known") > known_by), "risk_free_late")
    return out.withColumn("reason", reason).withColumn("rate", F.when(reason.isNull(), F.col("rate"))).drop("n", "known")


def study_violations(declared: DataFrame, found: DataFrame, cases: DataFrame, spans: DataFrame) -> DataFrame:
    """(reason, item) of a saved study: cases (signal, cost_bps, n) declared but not found, found but not declared, or found
    several times; summaries whose n is not their number of periods (cases: signal, cost_bps, month); spans (trace_id, span_id)
    that occur twice."""
    name = F.concat_ws("/", "signal", F.col("cost_bps").cast("string")).alias("item")
    keys = ["signal", "cost_bps"]
    parts = [
        declared.join(found, keys, "left_anti").select(F.lit("case_missing").alias("reason"), name), found.join(declared, keys, "left_anti").select(F.lit("case_undeclared").alias("reason"), name),
        found.groupBy(*keys).count().filter("count > 1").select(F.lit("case_repeated").alias("reason"), name),
        found.join(cases.groupBy(*keys).agg(F.count("*").alias("periods")), keys, "left").filter("n <> coalesce(periods, 0)").select(F.lit("periods_differ").alias("reason"), name),
        spans.groupBy("trace_id", "span_id").count().filter("count > 1").select(F.lit("span_repeated").alias("reason"), F.concat_ws("/", F.col("trace_id").cast("string"), F.col("span_id").cast("string")).alias("item")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
