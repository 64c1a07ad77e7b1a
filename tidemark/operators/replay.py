"""Accounts with corporate actions: splits, dividends and exits as claims, payments into cash, and what contradicts them.

Nothing is folded event by event. Shares are kept in units before any split: a fill adds its quantity over the split factor of
its day, and at any day shares are the running sum times that day's factor. So positions, entitlements and cash are
running sums, which are cut into time shards for accounts and securities with many events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ledger import running_totals

#: What comes first of one day: actions take effect, then fills.
ACTION, FILL = 0, 2


@dataclass(frozen=True)
class Books:
    """positions (account, security_id, shares), claims (account, action_id, security_id, pay_at, amount), balances (account,
    cash, fees, claims) and violations (reason, account, security_id, t), all as of one day."""

    positions: DataFrame
    claims: DataFrame
    balances: DataFrame
    violations: DataFrame


def _with_factor(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """rows (security_id, t, ..) with factor, the product of the security's split ratios up to t."""
    names = [c for c in rows.columns if c not in ("security_id", "t")]
    steps = splits.select("security_id", "t", F.lit(0).alias("turn"), F.log(F.col("new_shares") / F.col("old_shares")).alias("step"))
    asks = rows.select("security_id", "t", F.lit(1).alias("turn"), F.lit(0.0).alias("step"), F.struct(*names).alias("row"))
    line = running_totals(steps.unionByName(asks, allowMissingColumns=True), "security_id", F.col("t"), ["turn"], {"logs": "step"})
    return line.filter("turn = 1").select("security_id", "t", "row.*", F.exp("logs").alias("factor"))


def replay(fills: DataFrame, actions: DataFrame, initial: DataFrame, fee_bps: float, at: int) -> Books:
    """The books at the end of day `at` of fills (account, security_id, t, fill_id, quantity, price), actions (security_id,
    action_id, t, kind, old_shares, new_shares, cash_per_share, pay_at) and initial (account, cash).

    kind is split, dividend or terminal_exit. A day's actions come before its fills. A dividend or exit with an amount of cash
    per share gives every holder a signed claim, paid into cash on pay_at; an exit ends the position. Left out, and listed as
    violations: fills and actions of a security from its exit on (trade_after_exit, action_after_exit), and exits without
    an amount while shares are held (unknown_exit). Rows with a null account, security or day are left out.
    """
    fills = fills.filter("account is not null and security_id is not null and t is not null")
    actions = actions.filter("security_id is not null and t is not null")
    initial = initial.filter("account is not null")
    exits = actions.filter("kind = 'terminal_exit'").groupBy("security_id").agg(F.min("t").alias("exit_t"), F.min_by("action_id", F.struct("t", "action_id")).alias("exit_id"))
    done = fills.filter(F.col("t") <= at).join(exits, "security_id", "left")
    late = F.col("exit_t").isNotNull() & (F.col("t") >= F.col("exit_t"))
    acted = actions.filter(F.col("t") <= at).join(exits, "security_id", "left")
    stale = F.col("exit_t").isNotNull() & (F.struct("t", "action_id") > F.struct("exit_t", "exit_id"))
    own, live = done.filter(~late), acted.filter(~stale)
    splits = live.filter("kind = 'split'").select("security_id", "t", "old_shares", "new_shares")
    factored = _with_factor(own.select("account", "security_id", "t", "fill_id", "quantity", "price"), splits)
    units = factored.withColumn("units", F.col("quantity") / F.col("factor"))
    holders = own.select("account", "security_id").distinct()
    entitled = _with_factor(live.filter("kind <> 'split'").select("security_id", "t", "action_id", "kind", "cash_per_share", "pay_at"), splits)
    asks = entitled.join(holders, "security_id").select("account", "security_id", "t", F.lit(ACTION).alias("turn"), F.lit(0.0).alias("units"), F.struct("action_id", "kind", "cash_per_share", "pay_at", "factor").alias("action"))
    line = units.select("account", "security_id", "t", F.lit(FILL).alias("turn"), "units").unionByName(asks, allowMissingColumns=True)
    line = line.withColumn("pair", F.concat_ws("\x00", "account", "security_id")).withColumn("id", F.coalesce(F.col("action.action_id").cast("string"), F.lit("")))
    held = running_totals(line, "pair", F.col("t"), ["turn", "id", "units"], {"base": "units"}).filter("turn = 0").withColumn("shares", F.round(F.col("base") * F.col("action.factor"), 9))
    owed = held.filter("shares <> 0 and action.cash_per_share is not null").select("account", "action.action_id", "security_id", "action.pay_at", (F.col("shares") * F.col("action.cash_per_share")).alias("amount"))
    last = _with_factor(holders.select("security_id").distinct().withColumn("t", F.lit(at).cast("bigint")).withColumn("one", F.lit(1)), splits).select("security_id", F.col("factor").alias("now"))
    sums = units.groupBy("account", "security_id").agg(F.sum("units").alias("base")).join(last, "security_id").join(exits, "security_id", "left")
    gone = F.coalesce(F.col("exit_t") <= at, F.lit(False))
    positions = sums.select("account", "security_id", F.when(gone, 0.0).otherwise(F.round(F.col("base") * F.col("now"), 9)).alias("shares"))
    notional = F.col("quantity") * F.col("price")
    moves = own.select("account", (-notional - F.abs(notional) * (fee_bps / 1e4)).alias("cash"), (F.abs(notional) * (fee_bps / 1e4)).alias("fees"), F.lit(0.0).alias("claims"))
    paid = F.col("pay_at") <= at
    moves = moves.unionByName(owed.select("account", F.when(paid, F.col("amount")).otherwise(0.0).alias("cash"), F.lit(0.0).alias("fees"), F.when(paid, 0.0).otherwise(F.col("amount")).alias("claims")))
    moves = moves.unionByName(initial.select("account", "cash", F.lit(0.0).alias("fees"), F.lit(0.0).alias("claims")))
    balances = moves.groupBy("account").agg(*[F.sum(c).alias(c) for c in ("cash", "fees", "claims")])
    nobody = F.lit(None).cast(fills.schema["account"].dataType)
    wrong = done.filter(late).select(F.lit("trade_after_exit").alias("reason"), "account", "security_id", "t")
    wrong = wrong.unionByName(acted.filter(stale).select(F.lit("action_after_exit").alias("reason"), nobody.alias("account"), "security_id", "t"))
    unknown = held.filter("action.kind = 'terminal_exit' and action.cash_per_share is null and shares <> 0")
    return Books(positions, owed.filter(~paid), balances, wrong.unionByName(unknown.select(F.lit("unknown_exit").alias("reason"), "account", "security_id", "t")))


def net_asset_value(books: Books, prices: DataFrame) -> DataFrame:
    """(account, nav, unpriced): cash, outstanding claims and held shares at prices (security_id, price); unpriced counts held
    securities without a price, which add nothing."""
    held = books.positions.filter("shares <> 0").join(prices, "security_id", "left")
    worth = held.groupBy("account").agg(F.sum(F.coalesce(F.col("shares") * F.col("price"), F.lit(0.0))).alias("worth"), F.count(F.when(F.col("price").isNull(), 1)).alias("unpriced"))
    out = books.balances.join(worth, "account", "left")
    return out.select("account", (F.col("cash") + F.col("claims") + F.coalesce("worth", F.lit(0.0))).alias("nav"), F.coalesce("unpriced", F.lit(0)).alias("unpriced"))


def cash_steps(fills: DataFrame, fee_bps: float) -> DataFrame:
    """A second derivation of fees and cash from fills alone: (account, fill_id, cash_step, fee), side by side with what the
    running ledger says, for reconciling."""
    notional: Column = F.col("quantity") * F.col("price")
    return fills.select("account", "fill_id", (-notional - F.abs(notional) * fee_bps / 10_000).alias("cash_step"), (F.abs(notional) * fee_bps / 10_000).alias("fee"))
