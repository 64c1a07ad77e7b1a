"""Cutting hot keys into time shards, so that no ordered scan puts a whole hot key into one task.

An ordered operator runs its window or sweep over (key, shard) instead of key. A key is hot if it holds more rows than a
task should get: a quarter of an even share of the table for each core, within what the memory of a core holds sorted.
So what is cut follows from the table and the cluster, not from one fixed size. At most MAX_HOT keys are hot and 2 * MAX_HOT + 1
shards of them exist: what is collected and broadcast here has that bound whatever the size of the table. All other keys
are one shard, number 0.

Each operator then mends its own shard edges: by a carry-in (a running value of all earlier shards), by
a halo (copies of the neighbouring rows) or by stitching the edge rows of neighbouring shards.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import checkpoint

TARGET_ROWS: int | None = None  # a fixed size in place of the one that follows from table and cluster
LEAST_ROWS, BYTES_OF_ROW = 50_000, 1_000
MAX_HOT, MAX_SHARDS_OF_KEY = 65_536, 8_192
SHARD = "_shard"


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", text.strip().lower()).groups()
    return int(number) * 1024 ** (" kmgt".index(unit) if unit else 0)


def rows_of_shard(spark: SparkSession, all_rows: int) -> int:
    """How many rows of one key a task should get."""
    conf = spark.sparkContext.getConf()
    memory = conf.get("spark.driver.memory" if spark.sparkContext.master.startswith("local[") else "spark.executor.memory", "1g")
    parallel = max(1, spark.sparkContext.defaultParallelism)
    at_once = parallel if spark.sparkContext.master.startswith("local[") else int(conf.get("spark.executor.cores", "2"))
    most = max(LEAST_ROWS, _bytes(memory) // max(1, at_once) // BYTES_OF_ROW)
    return max(min(most, max(LEAST_ROWS, all_rows // (4 * parallel))), all_rows // MAX_HOT)


@dataclass
class ShardPlan:
    keys: list[str]
    time: str
    bounds: DataFrame | None = None  # keys..., _bounds array<bigint>
    shards: DataFrame | None = None  # keys..., _shard: every shard of the hot keys
    hot: int = 0
    rows: DataFrame | None = None  # the hot keys' rows, written once where they are read several times

    def assign(self, df: DataFrame, hot: str | None = None) -> DataFrame:
        """Adds _shard: how many of the key's bounds are not after the row's time; and `hot`, whether its key is."""
        if self.bounds is None:
            return df.withColumn(SHARD, F.lit(0)).withColumns({hot: F.lit(False)} if hot else {})
        hit = df.join(F.broadcast(self.bounds), self.keys, "left")
        before = F.size(F.filter("_bounds", lambda b: b <= F.col(self.time)))
        hit = hit.withColumn(SHARD, F.when(F.col("_bounds").isNull(), 0).otherwise(before))
        return (hit.withColumn(hot, F.col("_bounds").isNotNull()) if hot else hit).drop("_bounds")

    def only_hot(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.bounds.select(*self.keys)), self.keys, "left_semi")

    def not_hot(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.bounds.select(*self.keys)), self.keys, "left_anti")

    def keep(self, df: DataFrame) -> DataFrame:
        """df as a checkpoint if there are hot keys, whose edges are mended by reading it again; else df as it is."""
        return checkpoint(df) if self.hot else df

    def carry_in(self, summary: DataFrame, *values: Column) -> DataFrame:
        """Of a summary with one row per hot (key, shard): what is aggregated of all earlier shards, for each shard.
        The summary has at most 2 * MAX_HOT + 1 rows, so the result may be broadcast."""
        w = Window.partitionBy(*self.keys).orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)
        spine = F.broadcast(self.shards).join(F.broadcast(summary), [*self.keys, SHARD], "left")
        return spine.select(*self.keys, SHARD, *[v.over(w).alias(f"_carry{i}") for i, v in enumerate(values)])


def plan_shards(df: DataFrame, keys: list[str], time: str, target_rows: int | None = None, least_rows: int = 1, sized: DataFrame | None = None, size: Column | None = None) -> ShardPlan:
    """Finds the hot keys of df and the time bounds of their shards.

    time is a bigint column. Every shard but perhaps a key's only one gets at least least_rows rows (needed for halos) of
    `sized` (df if it is not given), counted as `size` says; the hot keys' rows of `sized` are written once, as plan.rows.
    Rows of equal key and time always share a shard. Rows with a null key or time must be gone already.
    """
    per_key = df.groupBy(*keys).count()
    all_rows, most = per_key.agg(F.sum("count"), F.max("count")).first()
    spark = df.sparkSession
    target = target_rows or TARGET_ROWS or rows_of_shard(spark, all_rows or 0)
    if not most or most <= target:
        return ShardPlan(keys, time)
    hot = {tuple(r[k] for k in keys): r["count"] for r in per_key.filter(F.col("count") > target).collect()}  # at most MAX_HOT rows
    names = spark.createDataFrame(list(hot), df.select(*keys).schema)
    cuts = min(MAX_SHARDS_OF_KEY, -(-most // target))
    grid = [i / cuts for i in range(1, cuts)]
    mine = (df if sized is None else sized).join(F.broadcast(names), keys, "left_semi")
    if sized is not None:
        mine = checkpoint(mine)
    found = mine.groupBy(*keys).agg(F.percentile_approx(time, F.array(*map(F.lit, grid)), 20 * cuts).alias("q")).collect()
    bounds: dict[tuple, list[int]] = {}
    for r in found:
        key = tuple(r[k] for k in keys)
        parts = min(cuts, -(-hot[key] // target))
        bounds[key] = sorted({r["q"][round(i * cuts / parts) - 1] for i in range(1, parts)})

    def table(b: dict[tuple, list[int]]) -> DataFrame:
        return spark.createDataFrame([(*k, v) for k, v in b.items()], T.StructType([*names.schema.fields, T.StructField("_bounds", T.ArrayType(T.LongType()))]))

    plan = ShardPlan(keys, time, table(bounds))
    if least_rows > 1:  # join shards that are too small to hold a halo
        sizes = {(tuple(r[k] for k in keys), r[SHARD]): r["n"] for r in plan.assign(mine).groupBy(*keys, SHARD).agg((F.count("*") if size is None else size).alias("n")).collect()}
        for key, own in bounds.items():
            kept, run = [], 0
            for i, b in enumerate(own):
                run += sizes.get((key, i), 0)
                if run >= least_rows:
                    kept.append(b)
                    run = 0
            if kept and run + sizes.get((key, len(own)), 0) < least_rows:
                kept.pop()
            bounds[key] = kept
        plan.bounds = table(bounds)
    plan.shards = spark.createDataFrame([(*k, i) for k, v in bounds.items() for i in range(len(v) + 1)], T.StructType([*names.schema.fields, T.StructField(SHARD, T.IntegerType())]))
    plan.hot = len(hot)
    plan.rows = mine if sized is not None else None
    return plan
