"""Budgets kept as an append-only history of reservations and settlements.

Whether a reservation is granted depends on all that were granted before it, so a history is walked in order. The walk
holds a few numbers and the identifiers of one account, and goes over a sorted partition batch by batch; accounts run side by
side, one account one after another by its nature.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ledger import running_totals

_OUT = "account string, seq bigint, operation_id string, kind string, outcome string, committed bigint"


def _walk(cap: int, deadline: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, committed, clock, breached = object(), 0, None, False
        open_: dict[str, tuple] = {}
        settled: dict[str, tuple] = {}
        for pdf in batches:
            out = []
            for who, seq, at, op, kind, amount in zip(*(pdf[c] for c in ("account", "seq", "at", "operation_id", "kind", "amount")), strict=True):
                if who != account:
                    account, committed, clock, breached = who, 0, None, False
                    open_.clear()
                    settled.clear()
                amount = None if pd.isna(amount) else int(amount)
                if kind == "reserve":
                    if op in open_:
                        outcome = "replayed" if open_[op] == amount else "identity_conflict"
                    elif breached:
                        outcome = "breached"
                    elif at >= deadline:
                        outcome = "past_deadline"
                    elif clock is not None and at < clock:
                        outcome = "clock_back"
                    elif committed + amount > cap:
                        outcome = "over_capacity"
                    else:
                        outcome, open_[op], clock = "granted", amount, at
                        committed += amount
                elif op not in open_:
                    outcome = "unreserved"
                elif op in settled:
                    outcome = "replayed" if settled[op] == (amount, at) else "settlement_conflict"
                elif clock is not None and at < clock:
                    outcome = "clock_back"
                else:
                    outcome, settled[op], clock = "settled", (amount, at), at
                    if amount is not None:  # an unknown charge keeps its reservation
                        committed += amount - open_[op]
                        breached = breached or amount > open_[op]
                out.append((who, seq, op, kind, outcome, committed))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return run


def decide(events: DataFrame, cap: int, deadline: int) -> DataFrame:
    """Of events (account, seq, at, operation_id, kind, amount) the outcome of each and what is committed after it.

    kind is reserve (amount: the most it may cost) or settle (amount: what it did cost, null if unknown). A reservation is
    granted unless its operation is known (replayed, or identity_conflict with another amount), the budget was overrun by a
    charge (breached), the time has come (past_deadline), the clock went back, or the cap would be passed; what is not granted adds
    nothing. A settlement puts a known charge in its reservation's place, once; at is a number. Rows with a null account or
    operation are left out; of equal seq, at decides, then the operation.
    """
    rows = events.filter("account is not null and operation_id is not null").select(F.col("account").cast("string").alias("account"), F.col("seq").cast("bigint").alias("seq"), F.col("at").cast("bigint").alias("at"), F.col("operation_id").cast("string").alias("operation_id"), "kind", F.col("amount").cast("bigint").alias("amount"))
    return rows.repartition("account").sortWithinPartitions("account", "seq", "at", "operation_id", "kind").mapInPandas(_walk(cap, deadline), _OUT)


def history_violations(events: DataFrame, cap: int, deadline: int) -> DataFrame:
    """(account, seq, reason) of a saved history (account, seq, at, kind, change) of granted events, change what each adds to the
    commitment: sequence (seq is not 0, 1, 2 ..), clock_back, past_deadline and over_capacity at a reservation."""
    step = F.lag("seq").over(Window.partitionBy("account").orderBy("seq"))
    rows = events.withColumn("before", step)
    line = running_totals(rows, "account", F.col("seq"), ["at"], {"committed": "change"}, {"latest": "at"})
    reserve = F.col("kind") == "reserve"
    checks = {
        "sequence": F.col("seq") != F.coalesce(F.col("before") + 1, F.lit(0)), "clock_back": F.coalesce(F.col("at") < F.col("latest"), F.lit(False)),
        "past_deadline": reserve & (F.col("at") >= deadline), "over_capacity": reserve & (F.col("committed") > cap),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return line.select("account", "seq", F.explode(found).alias("reason"))


def within_ceiling(allowances: DataFrame, ceiling: int) -> DataFrame:
    """(batch, total, admitted): whether the allowances (batch, case_id, allowance) of a batch, each case once, stay within the
    ceiling; checked before any of them is spent."""
    one = allowances.groupBy("batch", "case_id").agg(F.max("allowance").alias("allowance"))
    return one.groupBy("batch").agg(F.sum("allowance").cast("bigint").alias("total")).withColumn("admitted", F.col("total") <= ceiling)
