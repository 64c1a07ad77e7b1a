"""Accounts: event timelines, running cash and positions, claims, valuation and performance.

Running sums go over (account, shard): accounts with more events than a task should hold are cut by time, with the sums
of all earlier shards as carry-in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.timeshard import SHARD, plan_shards


def conflicts_of(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys that come with several contents; exact copies are no conflict."""
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("n_versions"), F.count("*").alias("n_rows")).filter("n_versions > 1")


def event_timeline(effective: DataFrame, payments: DataFrame, fills: DataFrame, target_rows: int | None = None) -> DataFrame:
    """One line of (account, at date, phase, event_id, amount) in which what takes effect comes before payments, and
    payments before fills, of the same day; seq numbers each account's events in that order."""
    phases = [x.withColumn("phase", F.lit(i)) for i, x in enumerate((effective, payments, fills))]
    line = phases[0].unionByName(phases[1]).unionByName(phases[2]).withColumn("one", F.lit(1))
    return running_totals(line, "account", F.unix_date("at"), ["phase", "event_id", "amount"], {"seq": "one"}, target_rows=target_rows).drop("one")


def running_totals(events: DataFrame, key: str, time: Column, order: list[str], sums: dict[str, str], highs: dict[str, str] | None = None, target_rows: int | None = None) -> DataFrame:
    """events with a running total for each of sums (new column -> added column), and the highest earlier value for each of
    highs, per key in order of time, then order. Rows with a null key or time are left out."""
    highs = highs or {}
    rows = events.withColumn("_key", F.col(key)).withColumn("_t", time.cast("bigint")).filter("_key is not null and _t is not null")
    plan = plan_shards(rows.select("_key", "_t"), ["_key"], "_t", target_rows)
    placed = plan.assign(rows)
    w = Window.partitionBy("_key", SHARD).orderBy("_t", *order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    totals = {new: F.sum(old).over(upto) for new, old in sums.items()} | {new: F.max(old).over(before) for new, old in highs.items()}
    if plan.hot:
        aggregates = [*[F.sum(old) for old in sums.values()], *[F.max(old) for old in highs.values()]]
        parts = plan.only_hot(placed).groupBy("_key", SHARD).agg(*[a.alias(f"_s{i}") for i, a in enumerate(aggregates)])
        again = [F.sum(f"_s{i}") if i < len(sums) else F.max(f"_s{i}") for i in range(len(aggregates))]
        placed = placed.join(F.broadcast(plan.carry_in(parts, *again)), ["_key", SHARD], "left")
        totals = {new: t + F.coalesce(F.col(f"_carry{i}"), F.lit(0)) if new in sums else F.greatest(t, F.col(f"_carry{i}")) for i, (new, t) in enumerate(totals.items())}
    return placed.withColumns(totals).drop("_key", "_t", SHARD, *[f"_carry{i}" for i in range(len(totals))])


def fill_cash(shares: Column, price: Column, fee_bps: float) -> Column:
    """What a fill adds to cash: less its notional and the fee on its size."""
    return -shares * price - F.abs(shares * price) * (fee_bps / 1e4)


def claims(positions: DataFrame, actions: DataFrame) -> DataFrame:
    """(account, action_id, pay_at, amount): each dividend's claim on the shares held when it takes effect. positions has the
    running shares (account, security_id, t, shares); actions (security_id, action_id, t, pay_at, per_share)."""
    w = Window.partitionBy("account", "security_id").orderBy("t", "turn").rowsBetween(Window.unboundedPreceding, 0)
    holders = positions.select("account", "security_id").distinct()
    asks = actions.join(holders, "security_id").select("account", "security_id", "t", F.lit(1).alias("turn"), "action_id", "pay_at", "per_share")
    line = positions.select("account", "security_id", "t", F.lit(0).alias("turn"), "shares").unionByName(asks, allowMissingColumns=True)
    held = line.withColumn("held", F.last("shares", ignorenulls=True).over(w)).filter("turn = 1 and held <> 0")
    return held.select("account", "action_id", "pay_at", (F.col("held") * F.col("per_share")).alias("amount"))


def valuation(balances: DataFrame, prices: DataFrame) -> DataFrame:
    """(account, nav, unpriced) of balances (account, security_id, shares, cash once for each account) at prices."""
    by = balances.join(prices, "security_id", "left").groupBy("account")
    unpriced = F.count(F.when(F.col("price").isNull() & (F.col("shares") != 0), 1))
    return by.agg((F.max("cash") + F.sum(F.coalesce(F.col("shares") * F.col("price"), F.lit(0.0)))).alias("nav"), unpriced.alias("unpriced"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose values differ between two derivations, or that only one of them has."""
    a, b = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l")), right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    both = a.join(b, keys, "full")
    return both.filter(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))).drop("_l", "_r")


def nav_returns(nav: DataFrame) -> DataFrame:
    """nav (series, at, nav) with the return from the observation before."""
    w = Window.partitionBy("series").orderBy("at")
    return nav.withColumn("ret", F.col("nav") / F.lag("nav").over(w) - 1)


def drawdowns(nav: DataFrame) -> DataFrame:
    """nav with its fall from the highest value so far, at least zero."""
    upto = Window.partitionBy("series").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return nav.withColumn("drawdown", 1 - F.col("nav") / F.max("nav").over(upto))


def performance_summary(returns: DataFrame, per_year: int) -> DataFrame:
    """Of (series, ret, risk_free) the mean, mean excess, variance and Sharpe ratio, each null with a reason where it is not
    available: no_return_periods, fewer_than_two_periods, zero_variance."""
    excess = F.col("ret") - F.col("risk_free")
    by = returns.filter("ret is not null").groupBy("series").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.avg(excess).alias("mean_excess"), F.var_samp(excess).alias("variance"))
    ratio = F.when(F.col("variance") > 0, F.sqrt(F.lit(float(per_year))) * F.col("mean_excess") / F.sqrt("variance"))
    reason = F.when(F.col("n") == 0, "no_return_periods").when(F.col("n") < 2, "fewer_than_two_periods").when(F.col("variance") == 0, "zero_variance")
    return by.withColumn("sharpe", ratio).withColumn("reason", reason)


def turnover(batches: DataFrame) -> DataFrame:
    """Of (account, batch, traded, nav_before), one row for each batch after dedupe, the sum of traded / nav_before."""
    one = batches.groupBy("account", "batch").agg(F.max("traded").alias("traded"), F.max("nav_before").alias("nav_before"))
    return one.groupBy("account").agg(F.sum(F.try_divide("traded", "nav_before")).alias("turnover"), F.count("*").alias("n_batches"))
