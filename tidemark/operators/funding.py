"""Funding and sizing of a rebalance. Rows are (batch, security_id, weight, old, price, ..); amounts in dollars."""

from __future__ import annotations

from bisect import bisect_left
from fractions import Fraction
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def post_fee_roots(rows: DataFrame, equity: float, cost: float) -> DataFrame:
    """(batch, root): v with v + cost * sum |v * weight - old| = equity, if cost * sum |weight| < 1 and cost * sum |old| <
    equity. The sum is piecewise affine in v; running sums over the break points old / weight give every piece, and the
    root of the piece that holds its own root is taken."""
    base = rows.select("batch", F.coalesce("weight", F.lit(0.0)).alias("w"), F.coalesce("old", F.lit(0.0)).alias("o"))
    fits = base.groupBy("batch").agg((F.lit(cost) * F.sum(F.abs("w"))).alias("cw"), (F.lit(cost) * F.sum(F.abs("o"))).alias("co"))
    fits = fits.filter((F.col("cw") < 1) & (F.col("co") < equity)).select("batch")
    parts = base.withColumn("at", F.when(F.col("w") != 0, F.greatest(F.col("o") / F.col("w"), F.lit(0.0))))
    # every name adds |w| |v - old / w|, which below its break point falls and above it rises
    slope, level = F.abs("w"), F.abs("w") * F.when(F.col("w") != 0, F.col("o") / F.col("w"))
    inside = (F.col("at") > 0) & (F.col("at") < equity)
    start_slope = F.sum(F.when(F.col("w") == 0, 0.0).when(F.col("at") > 0, -slope).otherwise(slope))
    start_level = F.sum(F.when(F.col("w") == 0, F.abs("o")).when(F.col("at") > 0, level).otherwise(-level))
    first = parts.groupBy("batch").agg(start_slope.alias("ds"), start_level.alias("dl")).select("batch", F.lit(0.0).alias("at"), "ds", "dl")
    turns = parts.filter(inside).groupBy("batch", "at").agg((2 * F.sum(slope)).alias("ds"), (-2 * F.sum(level)).alias("dl"))
    w = Window.partitionBy("batch").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    pieces = first.unionByName(turns).select("batch", "at", F.coalesce(F.lead("at").over(w), F.lit(equity)).alias("to"), F.sum("ds").over(upto).alias("s"), F.sum("dl").over(upto).alias("l"))
    root = (F.lit(equity) - cost * F.col("l")) / (1 + cost * F.col("s"))
    found = pieces.withColumn("root", root).filter((F.col("root") >= F.col("at") - 1e-9) & (F.col("root") <= F.col("to") + 1e-9))
    return found.join(fits, "batch", "left_semi").groupBy("batch").agg(F.min_by("root", "at").alias("root"))


def _exact_root(pdf: pd.DataFrame) -> pd.DataFrame:
    """v + cost * sum |v w - o| - equity rises in v, so its root lies where it changes sign among the sorted break points.
    At each of these the sum is had from running totals of w and o before and after it."""
    equity, cost = Fraction(pdf["equity"].iloc[0]), Fraction(pdf["cost"].iloc[0])
    book = sorted(((Fraction(o) / w, abs(w)) for w, o in zip(map(Fraction, pdf["weight"]), pdf["old"], strict=True) if w), key=lambda n: n[0])
    fixed = sum((abs(Fraction(o)) for w, o in zip(pdf["weight"], pdf["old"], strict=True) if not Fraction(w)), Fraction(0))
    turns = [n[0] for n in book]
    slopes, levels = [Fraction(0), *accumulate(n[1] for n in book)], [Fraction(0), *accumulate(n[0] * n[1] for n in book)]

    def line(k: int) -> tuple[Fraction, Fraction]:  # the sum as slope * v + level where k break points lie below v
        return 2 * slopes[k] - slopes[-1], fixed + levels[-1] - 2 * levels[k]

    def over(k: int) -> bool:
        slope, level = line(k)
        return turns[k] + cost * (slope * turns[k] + level) >= equity

    root = None
    if cost * slopes[-1] < 1 and cost * (fixed + sum(abs(n[0]) * n[1] for n in book)) < equity:
        slope, level = line(bisect_left(range(len(turns)), True, key=over))
        root = (equity - cost * level) / (1 + cost * slope)
    return pd.DataFrame([(pdf["batch"].iloc[0], None if root is None else str(root.numerator), None if root is None else str(root.denominator))], columns=["batch", "num", "den"])


def post_fee_roots_exact(rows: DataFrame) -> DataFrame:
    """The same in exact rationals, from decimal strings (batch, weight, old, equity, cost) to (batch, num, den). Whole
    batches come to one Python task, sorted once: for books of thousands of names, not for tables."""
    return rows.groupBy("batch").applyInPandas(_exact_root, "batch string, num string, den string")


def toward_zero(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


def whole_shares(rows: DataFrame, cost: float) -> DataFrame:
    """rows (batch, security_id, target, price, old_shares) with whole shares, trades and fees."""
    shares = toward_zero(F.try_divide(F.col("target"), F.col("price"))).cast("bigint")
    out = rows.withColumn("shares", shares).withColumn("trade", (F.col("shares") - F.col("old_shares")).cast("bigint"))
    return out.withColumn("fee", F.abs(F.col("trade") * F.col("price")) * cost)


def collateral(rows: DataFrame) -> DataFrame:
    """(account, cash, restricted, free, nav, status) of positions (account, cash, notional), one cash for each account."""
    by = rows.groupBy("account").agg(F.max("cash").alias("cash"), F.sum(F.when(F.col("notional") < 0, -F.col("notional")).otherwise(0.0)).alias("restricted"), F.sum("notional").alias("net"))
    out = by.select("account", "cash", "restricted", (F.col("cash") - F.col("restricted")).alias("free"), (F.col("cash") + F.col("net")).alias("nav"))
    return out.withColumn("status", F.when(F.col("nav") <= 0, "insolvent").when(F.col("free") < 0, "unfunded").otherwise("funded"))


def claim_collateral(claims: DataFrame) -> DataFrame:
    """(account, receivable, reserved): receivables add value, every liability is reserved in full, nothing is netted."""
    pos, neg = F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0.0)), F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0.0))
    return claims.groupBy("account").agg(pos.alias("receivable"), neg.alias("reserved"), F.count("*").alias("n_claims"))
