"""Ranking a cross-section into buckets and weighted long and short sleeves; rows are (formation, security_id, signal, cap)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buckets(rows: DataFrame, k: int, least: int = 1) -> DataFrame:
    """rows with a signal, with bucket 0..k-1 of equal sizes, the lower ones one larger if need be; ties by security_id.
    Formations with fewer than k * least names get none."""
    have = rows.filter("signal is not null").withColumn("n", F.count("*").over(Window.partitionBy("formation"))).filter(F.col("n") >= k * least).drop("n")
    return have.withColumn("bucket", F.ntile(k).over(Window.partitionBy("formation").orderBy("signal", "security_id")) - 1)


def ordinals(rows: DataFrame) -> DataFrame:
    """Dense ranks from 0 of the distinct signals."""
    return rows.filter("signal is not null").withColumn("ordinal", F.dense_rank().over(Window.partitionBy("formation").orderBy("signal")) - 1)


def excluded(rows: DataFrame) -> DataFrame:
    """The names without a signal, as one sorted list for each formation that has some."""
    return rows.filter("signal is null").groupBy("formation").agg(F.concat_ws(",", F.sort_array(F.collect_set("security_id"))).alias("excluded"), F.count_distinct("security_id").alias("n"))


def sleeve_weights(bucketed: DataFrame, k: int, by_cap: bool, high_long: bool = True) -> DataFrame:
    """Weights of the outer buckets, one sleeve adding up to 1 and the other to -1; 0 inside."""
    sign = F.when(F.col("bucket") == k - 1, 1.0 if high_long else -1.0).when(F.col("bucket") == 0, -1.0 if high_long else 1.0).otherwise(0.0)
    part = Window.partitionBy("formation", "bucket")
    share = F.try_divide(F.col("cap"), F.sum("cap").over(part)) if by_cap else 1.0 / F.count("*").over(part)
    return bucketed.withColumn("weight", F.when(sign == 0, F.lit(0.0)).otherwise(sign * share))


def sleeve_totals(weighted: DataFrame) -> DataFrame:
    long, short = F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)), F.sum(F.when(F.col("weight") < 0, F.col("weight")).otherwise(0.0))
    return weighted.groupBy("formation").agg(long.alias("long_total"), short.alias("short_total"), F.count(F.when(F.col("weight") != 0, 1)).alias("n_held"))


def turnover_cost(desired: DataFrame, drifted: DataFrame, commission_bps: float, slippage_bps: float) -> DataFrame:
    """(formation, turnover, commission, slippage) over the union of the names on either side."""
    both = desired.filter("weight <> 0").select("formation", "security_id", F.col("weight").alias("new")).join(drifted.filter("weight <> 0").select("formation", "security_id", F.col("weight").alias("old")), ["formation", "security_id"], "full")
    turnover = F.sum(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))
    by = both.groupBy("formation").agg(turnover.alias("turnover"))
    return by.select("formation", "turnover", (F.col("turnover") * commission_bps / 1e4).alias("commission"), (F.col("turnover") * slippage_bps / 1e4).alias("slippage"))


def hybrid_scores(parts: DataFrame, weights: dict[str, tuple[float, int]]) -> DataFrame:
    """Of parts (part, formation, security_id, score) the weighted, direction-aligned sum where every part has a score."""
    if abs(sum(w for w, _ in weights.values()) - 1) > 1e-12:
        raise ValueError("weights must add up to one")
    factor = F.lit(None).cast("double")
    for name, (w, direction) in weights.items():
        factor = F.when(F.col("part") == name, F.lit(w * direction)).otherwise(factor)
    by = parts.filter(F.col("part").isin(*weights)).groupBy("formation", "security_id").agg(F.count("score").alias("n"), F.sum(F.col("score") * factor).alias("score"))
    return by.filter(F.col("n") == len(weights)).drop("n")


def rank_and_dedupe(ideas: DataFrame, score: Column) -> DataFrame:
    """ideas (idea_id, exec_hash, blocked) with score and status: blocked, else the best of its exec_hash is queued and the
    others are duplicates; ties by idea_id."""
    scored = ideas.withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("exec_hash", "blocked").orderBy(F.desc("score"), "idea_id"))
    return scored.withColumn("status", F.when(F.col("blocked"), "blocked").when(rank == 1, "queued").otherwise("duplicate"))
