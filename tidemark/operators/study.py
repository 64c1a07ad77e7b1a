"""Cross-sectional study: returns, monthly panels, signals, long/short weights, and portfolio returns with costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COSTS_BPS = (0, 10, 25)
MOMENTUM, REVERSAL, TREND, VOLATILITY, DOWNSIDE = (3, 6, 9, 12), (1, 3), (3, 6, 12), (3, 6, 12), (6, 12)


def daily_returns(panel: DataFrame) -> DataFrame:
    """panel (symbol, date, price) with daily_return, the change from the symbol's day before, null on its first."""
    before = F.lag("price").over(Window.partitionBy("symbol").orderBy("date"))
    return panel.withColumn("daily_return", F.col("price") / before - 1)


def monthly_aggregate(panel: DataFrame) -> DataFrame:
    """(symbol, month, first_date, first_price, close, daily_max); a month's first day moves from the month before."""
    by = daily_returns(panel).withColumn("month", F.date_format("date", "yyyy-MM")).groupBy("symbol", "month")
    return by.agg(
        F.min("date").alias("first_date"), F.min_by("price", "date").alias("first_price"), F.max_by("price", "date").alias("close"),
        F.coalesce(F.max("daily_return"), F.lit(0.0)).alias("daily_max"),
    )


def month_end_panel(panel: DataFrame) -> DataFrame:
    """The last session of each symbol and month with the one before it, across gaps, and the return between them."""
    last = Window.partitionBy("symbol", F.date_format("date", "yyyy-MM")).orderBy(F.desc("date"))
    ends = panel.withColumn("rn", F.row_number().over(last)).filter("rn = 1")
    w = Window.partitionBy("symbol").orderBy("date")
    ends = ends.withColumn("previous_date", F.lag("date").over(w)).withColumn("previous_price", F.lag("price").over(w))
    return ends.select("symbol", "date", "price", "previous_date", "previous_price", (F.col("price") / F.col("previous_price") - 1).alias("monthly_return"), F.year("date").alias("year"))


def month_gaps(monthly: DataFrame) -> DataFrame:
    """Months that do not follow the symbol's month before by one."""
    number = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
    w = Window.partitionBy("symbol").orderBy("month")
    return monthly.select("symbol", "month", F.lag("month").over(w).alias("previous_month"), (number - F.lag(number).over(w)).cast("int").alias("step")).filter("step <> 1")


def signal_scores(monthly: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(signal, symbol, month, score) of the fifteen signals, where enough months lie before."""
    w = Window.partitionBy("symbol").orderBy("month")
    rows = monthly.withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
    scores: dict[str, Column] = {}
    full = lambda col, n, value: F.when(F.count(col).over(w.rowsBetween(1 - n, 0)) == n, value)
    for n in MOMENTUM:
        scores[f"momentum_{n}_skip1"] = F.lag("close", 1).over(w) / F.lag("close", n).over(w) - 1
    for n in REVERSAL:
        scores[f"reversal_{n}"] = -(F.col("close") / F.lag("close", n).over(w) - 1)
    for n in TREND:
        scores[f"trend_{n}"] = full("close", n, F.col("close") / F.avg("close").over(w.rowsBetween(1 - n, 0)) - 1)
    for n in VOLATILITY:
        scores[f"low_volatility_{n}"] = full("r", n, -F.stddev_samp("r").over(w.rowsBetween(1 - n, 0)))
    for n in DOWNSIDE:
        scores[f"low_downside_{n}"] = full("r", n, -F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2)).over(w.rowsBetween(1 - n, 0))))
    scores["low_max_daily_1"] = -F.col("daily_max")
    wanted = names or list(scores)
    wide = rows.select("symbol", "month", *[scores[n].alias(n) for n in wanted])
    stacked = f"stack({len(wanted)}, {', '.join(f"'{n}', `{n}`" for n in wanted)}) as (signal, score)"
    return wide.selectExpr("symbol", "month", stacked).filter("score is not null")


def long_short_weights(scores: DataFrame, each: int = 2) -> DataFrame:
    """Of each (signal, month) the `each` highest scores long and lowest short, sleeves of one; ties by symbol. Months
    with fewer than two sleeves' names are left out."""
    part = Window.partitionBy("signal", "month")
    ranked = scores.withColumn("rank", F.row_number().over(part.orderBy("score", "symbol"))).withColumn("n", F.count("*").over(part)).filter(f"n >= {2 * each}")
    weight = F.when(F.col("rank") <= each, -1.0 / each).when(F.col("rank") > F.col("n") - each, 1.0 / each).otherwise(0.0)
    return ranked.select("signal", "month", "symbol", weight.alias("weight"))


def forward_returns(monthly: DataFrame) -> DataFrame:
    """(symbol, month, forward): entered at the first close of the next month, left at that of the month after."""
    w = Window.partitionBy("symbol").orderBy("month")
    return monthly.select("symbol", "month", (F.lead("first_price", 2).over(w) / F.lead("first_price", 1).over(w) - 1).alias("forward")).filter("forward is not null")


def portfolio_gross(weights: DataFrame, forward: DataFrame) -> DataFrame:
    """(signal, month, gross) without costs."""
    return weights.filter("weight <> 0").join(forward, ["symbol", "month"]).groupBy("signal", "month").agg(F.sum(F.col("weight") * F.col("forward")).alias("gross"))


def portfolio_net(weights: DataFrame, forward: DataFrame, costs_bps: tuple[int, ...] = COSTS_BPS) -> DataFrame:
    """(signal, cost_bps, month, turnover, fee, net, status) of the weights held each month, all of them sold in the last.

    What a month is entered with is last month's weight times its growth over one plus last month's net return, so the only
    thing that goes from month to month is that return. The pairs (weight, grown weight of the month before) of each month are
    made first; the recurrence is one ordered fold of numbers per signal and cost, in the JVM. A net
    return of -1 or less ends a case as insolvent. A case holds one row of a few pairs for each month of the study."""
    held = weights.filter("weight <> 0").join(forward, ["symbol", "month"]).withColumn("grown", F.col("weight") * (1 + F.col("forward")))
    months = held.groupBy("signal", "month").agg((F.sum("grown") - F.sum("weight")).alias("gross"), F.sum(F.abs("grown")).alias("ending"), F.collect_list(F.struct("symbol", "weight", "grown")).alias("names"))
    path = months.groupBy("signal").agg(F.array_sort(F.collect_list(F.struct("month", "gross", "ending", "names"))).alias("own"))
    by_name = lambda m, field: F.map_from_entries(F.transform(m["names"], lambda n: F.struct(n["symbol"], n[field])))
    nobody = F.expr("cast(map() as map<string, double>)")

    def with_pairs(m: Column, i: Column) -> Column:
        brought = F.when(i > 0, by_name(F.get(F.col("own"), i - 1), "grown")).otherwise(nobody)
        pairs = F.map_values(F.map_zip_with(by_name(m, "weight"), brought, lambda _, w, b: F.struct(F.coalesce(w, F.lit(0.0)).alias("w"), F.coalesce(b, F.lit(0.0)).alias("b"))))
        return F.struct(m["month"].alias("month"), m["gross"].alias("gross"), F.when(i == F.size("own") - 1, m["ending"]).otherwise(0.0).alias("sold"), pairs.alias("pairs"))

    path = path.select("signal", F.transform("own", with_pairs).alias("path"))
    cases = path.withColumn("cost_bps", F.explode(F.array(*map(F.lit, costs_bps))))
    none = F.expr("cast(array() as array<struct<month:string,turnover:double,fee:double,net:double>>)")

    def step(done: Column, m: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["net"], F.lit(0.0))
        turnover = F.aggregate(m["pairs"], F.lit(0.0), lambda s, p: s + F.abs(p["w"] - p["b"] / (1 + before)))
        fee = (turnover + m["sold"]) * F.col("cost_bps") / 1e4
        row = F.struct(m["month"].alias("month"), turnover.alias("turnover"), fee.alias("fee"), (m["gross"] - fee).alias("net"))
        return F.when((F.size(done) > 0) & (before <= -1), done).otherwise(F.concat(done, F.array(row)))

    folded = cases.select("signal", "cost_bps", F.explode(F.aggregate("path", none, step)).alias("m"))
    return folded.select("signal", "cost_bps", "m.month", "m.turnover", "m.fee", "m.net", F.when(F.col("m.net") <= -1, "insolvent").otherwise("complete").alias("status"))


def performance(returns: DataFrame, keys: list[str], order: str, value: str, per_year: int = 12) -> DataFrame:
    """keys with n, total_return, sharpe (null at no variance), max_drawdown (at most zero, from a peak of at least one)."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    nav = returns.withColumn("nav", F.product(1 + F.col(value)).over(upto))
    nav = nav.withColumn("fall", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(upto)) - 1)
    spread = F.stddev_samp(value)
    return nav.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.max_by("nav", order) - 1).alias("total_return"),
        F.when(spread > 0, F.sqrt(F.lit(float(per_year))) * F.avg(value) / spread).alias("sharpe"), F.min("fall").alias("max_drawdown"),
    )


def cumulative_nav(returns: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """returns with nav, the product of 1 + value so far, peak and the fall from it."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("nav", F.product(1 + F.col(value)).over(upto))
    return out.withColumn("drawdown", 1 - F.col("nav") / F.max("nav").over(upto))
