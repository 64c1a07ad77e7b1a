"""Point-in-time selection: what was known, and valid, at a decision instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.timeshard import SHARD, plan_shards

FACT_KEY = ["security_id", "concept", "period_start", "period_end", "unit"]


def known_facts(facts: DataFrame, at: Column) -> DataFrame:
    """Facts with available_at <= at; a null available_at is never known."""
    return facts.filter(F.col("available_at") <= at)


def select_facts(facts: DataFrame, at: Column) -> DataFrame:
    """Of each fact key the version with the latest (available_at, revision), of equal ones the smallest source_id. Two
    aggregations that combine before their shuffles; nothing is ranked."""
    known = known_facts(facts, at).groupBy(*FACT_KEY, "available_at", "revision").agg(F.min(F.struct("source_id", "value")).alias("s"))
    best = known.groupBy(*FACT_KEY).agg(F.max(F.struct("available_at", "revision", "s")).alias("v"))
    return best.select(*FACT_KEY, "v.available_at", "v.revision", "v.s.source_id", "v.s.value")


def fact_conflicts(facts: DataFrame, at: Column) -> DataFrame:
    """Over all known facts: (kind, key.., n) where one (key, source, revision) has several contents, or one (key,
    available_at, revision) several values as numbers."""
    known = known_facts(facts, at)
    number = F.expr("try_cast(value as double)")
    contents = known.groupBy(*FACT_KEY, "source_id", "revision").agg(F.count_distinct(F.struct("value", "available_at")).alias("n")).filter("n > 1")
    values = known.groupBy(*FACT_KEY, "available_at", "revision").agg(F.count_distinct(number).alias("n")).filter("n > 1")
    return contents.select(F.lit("content").alias("kind"), *FACT_KEY, "revision", "n").unionByName(values.select(F.lit("value").alias("kind"), *FACT_KEY, "revision", "n"))


def select_universe(membership: DataFrame, at: Column) -> DataFrame:
    """Included securities: of each the latest (effective_at, available_at) event known and effective at the instant, of
    equal ones the largest event_id, and kept only if it includes it."""
    known = membership.filter((F.col("available_at") <= at) & (F.col("effective_at") <= at))
    last = known.groupBy("security_id").agg(F.max(F.struct("effective_at", "available_at", "event_id", "included")).alias("m"))
    return last.filter("m.included").select("security_id", "m.effective_at", "m.event_id")


def membership_conflicts(membership: DataFrame) -> DataFrame:
    by = membership.groupBy("security_id", "effective_at", "available_at").agg(F.count_distinct("included").alias("n"), F.count("*").alias("events"))
    return by.filter("n > 1")


def monthly_cells(selected: DataFrame, cutoff: Column) -> DataFrame:
    """Instant facts up to the cutoff by month: (security_id, concept, unit, month, n, value, period_end); n > 1 is ambiguous."""
    rows = selected.filter(F.col("period_start").isNull() & (F.col("period_end") <= cutoff))
    by = rows.groupBy("security_id", "concept", "unit", F.trunc("period_end", "month").alias("month"))
    return by.agg(F.count("*").alias("n"), F.max_by("value", F.struct("period_end", "source_id")).alias("value"), F.max("period_end").alias("period_end"))


def requested_cells(securities: DataFrame, concepts: list[str], cutoff: Column, months: int) -> DataFrame:
    """Every security with each concept and each of the last `months` months ending at the cutoff's. The other side of this
    product is the request itself, months times concepts entries of one array, so no table is crossed with another."""
    last = F.trunc(cutoff, "month")
    spine = securities.select("security_id").distinct().withColumn("concept", F.explode(F.array(*map(F.lit, concepts))))
    return spine.withColumn("month", F.explode(F.sequence(F.add_months(last, 1 - months), last, F.expr("interval 1 month"))))


def cell_values(cells: DataFrame, selected_cells: DataFrame) -> DataFrame:
    """cells with value, null where it is missing; never filled."""
    return cells.join(selected_cells.select("security_id", "concept", "month", "value"), ["security_id", "concept", "month"], "left")


def complete_histories(values: DataFrame, months: int) -> DataFrame:
    """(security_id, concept, latest, series) where all months are there, series oldest first."""
    by = values.groupBy("security_id", "concept").agg(F.count("value").alias("n"), F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("month", "value")))).alias("s"))
    return by.filter(F.col("n") == months).select("security_id", "concept", F.element_at("s", -1)["value"].alias("latest"), F.transform("s", lambda x: x["value"]).alias("series"))


def invalid_facts(facts: DataFrame) -> DataFrame:
    """Facts that end after they were known, or before they began."""
    late = F.when(F.col("period_end") > F.to_date("available_at"), "ends_after_known")
    turned = F.when(F.col("period_start") > F.col("period_end"), "begins_after_end")
    return facts.withColumn("reason", F.explode(F.array_compact(F.array(late, turned)))).select("security_id", "concept", "source_id", "period_end", "reason").distinct()


def exact_quotes(requests: DataFrame, quotes: DataFrame) -> DataFrame:
    """requests (request_id, security_id, at) with the price quoted at exactly that instant and known by then; null if there
    is none. No last value is carried. Of several quotes the smallest source_id."""
    known = quotes.filter(F.col("available_at") <= F.col("observed_at")).groupBy("security_id", F.col("observed_at").alias("at")).agg(F.min(F.struct("source_id", "price_usd")).alias("q"))
    return requests.join(known, ["security_id", "at"], "left").select("request_id", "security_id", "at", "q.source_id", "q.price_usd")


def active_intervals(requests: DataFrame, intervals: DataFrame, target_rows: int | None = None) -> DataFrame:
    """requests (request_id, key, t) with how many of the closed intervals (key, from_us, through_us, amount) hold t and
    their total amount.

    Not a range join, which would pair every request of a hot key with all its intervals: starts, requests and ends lie on
    one line, and what is active is the running sum of starts less ends. Hot keys are cut by time with the sum of all
    earlier shards as carry-in.
    """
    starts = intervals.select("key", F.col("from_us").alias("t"), F.lit(0).alias("turn"), F.lit(1).alias("d"), "amount")
    ends = intervals.select("key", F.col("through_us").alias("t"), F.lit(2).alias("turn"), F.lit(-1).alias("d"), (-F.col("amount")).alias("amount"))
    asks = requests.select("key", "t", F.lit(1).alias("turn"), F.lit(0).alias("d"), F.lit(0).cast("bigint").alias("amount"), "request_id")
    line = starts.unionByName(ends).unionByName(asks, allowMissingColumns=True)
    plan = plan_shards(line.select("key", "t"), ["key"], "t", target_rows)
    placed = plan.assign(line)
    w = Window.partitionBy("key", SHARD).orderBy("t", "turn", "d", "amount").rowsBetween(Window.unboundedPreceding, 0)
    n, total = F.sum("d").over(w), F.sum("amount").over(w)
    if plan.hot:
        sums = plan.only_hot(placed).groupBy("key", SHARD).agg(F.sum("d").alias("dn"), F.sum("amount").alias("da"))
        placed = placed.join(F.broadcast(plan.carry_in(sums, F.sum("dn"), F.sum("da"))), ["key", SHARD], "left")
        n, total = n + F.coalesce("_carry0", F.lit(0)), total + F.coalesce("_carry1", F.lit(0))
    return placed.withColumn("n_active", n).withColumn("total", total).filter("turn = 1").select("request_id", "key", "t", F.col("n_active").cast("bigint"), F.col("total").cast("bigint"))

