"""Accounts with actions, budgets, exact numbers, guards and exports on hand-made inputs: nulls, ties, repeats, empty tables."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.operators import budgets, exactness, grading, guards, lineage, replay, validation
from tidemark.sources import exports

FILLS = "account string, security_id string, t bigint, fill_id string, quantity double, price double"
ACTIONS = "security_id string, action_id bigint, t bigint, kind string, old_shares double, new_shares double, cash_per_share double, pay_at bigint"


def test_replay_of_splits_claims_and_exits(spark):
    fills = [("u", "A", 1, "f1", 10.0, 5.0), ("u", "A", 5, "f2", 4.0, 3.0), ("u", "B", 2, "f3", -6.0, 2.0), ("u", "B", 9, "f4", 1.0, 2.0), ("v", "C", 1, "f5", 3.0, 1.0), (None, "A", 1, "f6", 1.0, 1.0)]
    actions = [("A", 1, 3, "split", 1.0, 2.0, None, None), ("A", 2, 5, "dividend", None, None, 0.5, 8), ("A", 3, 6, "dividend", None, None, 0.25, 99), ("B", 4, 7, "terminal_exit", None, None, 1.5, 8), ("B", 5, 8, "dividend", None, None, 9.0, 9), ("C", 6, 4, "terminal_exit", None, None, None, None)]
    initial = spark.createDataFrame([("u", 100.0), ("v", 10.0)], "account string, cash double")
    books = replay.replay(spark.createDataFrame(fills, FILLS), spark.createDataFrame(actions, ACTIONS), initial, 100.0, 10)
    assert {(r["account"], r["security_id"]): r["shares"] for r in books.positions.collect()} == {("u", "A"): 24.0, ("u", "B"): 0.0, ("v", "C"): 0.0}
    assert [(r["account"], r["action_id"], r["amount"]) for r in books.claims.collect()] == [("u", 3, 6.0)]
    u = next(r for r in books.balances.collect() if r["account"] == "u")
    fees = 0.01 * (50 + 12 + 12)
    assert u["fees"] == pytest.approx(fees) and u["claims"] == pytest.approx(6.0)
    assert u["cash"] == pytest.approx(100 - 50 - 12 + 12 - fees + 20 * 0.5 - 6 * 1.5)
    assert {(r["reason"], r["security_id"]) for r in books.violations.collect()} == {("trade_after_exit", "B"), ("action_after_exit", "B"), ("unknown_exit", "C")}
    nav = {r["account"]: (r["nav"], r["unpriced"]) for r in replay.net_asset_value(books, spark.createDataFrame([("A", 2.0)], "security_id string, price double")).collect()}
    assert nav["u"] == (pytest.approx(u["cash"] + 6 + 48), 0)
    empty = replay.replay(spark.createDataFrame([], FILLS), spark.createDataFrame([], ACTIONS), initial, 1.0, 10)
    assert empty.positions.count() == 0 and {r["cash"] for r in empty.balances.collect()} == {100.0, 10.0}


def test_budget_walk(spark):
    rows = [
        ("a", 0, 1, "x", "reserve", 50), ("a", 1, 2, "y", "reserve", 60), ("a", 2, 2, "z", "reserve", 40), ("a", 3, 3, "x", "settle", 20), ("a", 4, 3, "x", "reserve", 50), ("a", 5, 3, "x", "reserve", 51),
        ("a", 6, 2, "w", "reserve", 1), ("a", 7, 4, "v", "reserve", 30), ("a", 8, 5, "z", "settle", None), ("a", 9, 6, "v", "settle", 35), ("a", 10, 7, "t", "reserve", 1), ("a", 11, 7, "q", "settle", 1), ("b", 0, 9, "x", "reserve", 1), (None, 0, 1, "x", "reserve", 1),
    ]
    df = spark.createDataFrame(rows, "account string, seq bigint, at bigint, operation_id string, kind string, amount bigint")
    got = {(r["account"], r["seq"]): (r["outcome"], r["committed"]) for r in budgets.decide(df, 100, 9).collect()}
    assert [got["a", i][0] for i in range(12)] == ["granted", "over_capacity", "granted", "settled", "replayed", "identity_conflict", "clock_back", "granted", "settled", "settled", "breached", "unreserved"]
    assert got["a", 9][1] == 20 + 40 + 35 and got["b", 0] == ("past_deadline", 0) and len(got) == 13
    assert budgets.decide(df.limit(0), 1, 1).count() == 0


def test_fifty_digits_and_rationals():
    assert exactness.evaluate("a / b", {"a": "1", "b": "3"})[0] == "0." + "3" * 50
    assert exactness.evaluate("a / b", {"a": "2", "b": "6"}, True) == ("1/3", None)
    assert exactness.evaluate("0.1 + 0.2", {}) == ("0.3", None)
    assert exactness.evaluate("compound_return(r, 2)", {"r": ["9", "0.1", "-0.5"]}) == ("-0.45", None)
    assert exactness.evaluate("delta(p)", {"p": ["1.5", "4"]}) == ("2.5", None)
    for text, values, reason in (("a / (b - b)", {"a": "1", "b": "2"}, "zero_denominator"), ("a * a", {"a": "1e60"}, "magnitude"), ("a", {"a": None}, "missing"), ("a", {"a": "x"}, "number"), ("compound_return(r, 3)", {"r": ["1"]}, "too_short"), ("a / a / a", {"a": "1e-101"}, "magnitude")):
        assert exactness.evaluate(text, values) == (None, reason)
    many = " + ".join(["compound_return(r, 120)"] * 3)
    assert exactness.evaluate(many, {"r": ["0"] * 120}) == (None, "operations")


def test_order_of_decimals(spark):
    rng = random.Random(3)
    texts = ["0", "-0.0", "1.0", "1.00", " 1", "1e3", "1000", "-1e3", "1e-30", "-1e-30", "12345678901234567890.5", "12345678901234567890.25", *[f"{rng.randrange(-999, 999)}.{rng.randrange(99)}" for _ in range(40)], None, "", "x", "NaN"]
    df = spark.createDataFrame([("f", str(i), t) for i, t in enumerate(texts)], "formation string, security_id string, signal string")
    got = {int(r["security_id"]): r["ordinal"] for r in exactness.exact_ordinals(df).collect()}
    numbers = {i: Fraction(t.strip()) for i, t in enumerate(texts) if t not in (None, "", "x", "NaN")}
    ranks = {v: k for k, v in enumerate(sorted(set(numbers.values())))}
    assert got == {i: ranks[v] for i, v in numbers.items()}


def test_folds_tell_why_they_have_no_statistic(spark):
    rows = spark.createDataFrame([("s", i, i, i + 1, float(i % 3)) for i in range(11)], "series string, idx bigint, start bigint, available bigint, value double")
    got = {r["fold"]: (r["n"], r["n_train"], r["n_purged"], r["reason"], r["mean"]) for r in validation.fold_diagnostics(rows, 4, 3, 2).collect()}
    assert got[0][:4] == (3, 3, 1, None) and got[1][:2] == (3, 6) and got[2] == (1, 9, 1, "INSUFFICIENT_HAC_SAMPLE", None)
    states = spark.createDataFrame([("s", "completed"), ("t", "completed"), ("u", "failed")], "series string, status string")
    assert {r["series"]: r["reason"] for r in validation.validate_series(rows, states, 20, 2).collect()} == {"s": "INSUFFICIENT_SPLIT_SAMPLE", "t": "INSUFFICIENT_HAC_SAMPLE", "u": "EXPERIMENT_NOT_COMPLETED"}


def test_guards(spark):
    rows = spark.createDataFrame([(1, 1, 2), (2, 2, 2), (3, None, 2)], "id int, formation_at int, trade_at int")
    bad = guards.decision_times(rows)
    assert {(r["id"], r["reason"]) for r in bad.collect()} == {(2, "not_before_trade"), (3, "clock_missing")}
    guards.require_none(bad.limit(0), "never")
    with pytest.raises(guards.Refused):
        guards.require_none(bad, "DECISION_CLOCK")
    loans = spark.createDataFrame([("g1", "A", 5, 0, 10, 100), ("g2", "A", 0, 8, 20, 50), ("g2", "A", 0, 8, 20, 50)], "source_id string, security_id string, known_us bigint, from_us bigint, through_us bigint, amount bigint")
    asks = spark.createDataFrame([(1, "A", 4, -10), (2, "A", 5, -10), (3, "A", 8, -10), (4, "A", 10, -60), (5, "A", 11, -60), (6, "A", 20, -50), (7, "A", 21, -1), (8, "B", 1, -1)], "request_id int, security_id string, t bigint, quantity bigint")
    assert {r["request_id"]: r["status"] for r in guards.covering_loans(asks, loans).collect()} == {1: "missing", 2: "covered", 3: "ambiguous", 4: "covered", 5: "missing", 6: "covered", 7: "missing", 8: "missing"}


def test_weights_and_judgments(spark):
    w = spark.createDataFrame([("a", "x", 1, 3), ("a", "y", 2, 3), ("b", "x", 1, 2), ("b", "y", 1, 3), ("c", "x", 0, 1), ("d", "x", 1, 2), ("d", "x", 1, 2)], "synthesis_id string, source_id string, numerator int, denominator int")
    assert {(r["synthesis_id"], r["reason"]) for r in grading.weight_violations(w).collect()} == {("b", "not_one"), ("c", "not_positive"), ("d", "source_twice")}
    q, docs = spark.createDataFrame([("q",), ("r",)], "query_id string"), spark.createDataFrame([("1",), ("2",)], "doc_id string")
    judged = spark.createDataFrame([("q", "1"), ("q", "1"), ("q", "9")], "query_id string, doc_id string")
    assert {tuple(r) for r in grading.judgment_coverage(q, docs, judged).collect()} == {("q", 1, 1, 1), ("r", 2, 0, 0)}


def test_exports(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in exports.upsert(table, spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string"), "k").collect()} == {(1, "a"), (2, "c"), (3, "e")}
    path = tmp_path / "p"
    table.coalesce(1).write.parquet(str(path))
    file = next(path.glob("*.parquet"))
    import hashlib

    digest = hashlib.sha256(file.read_bytes()).hexdigest()
    assert exports.pinned_parquet(spark, str(file), digest, str(tmp_path / "shared")).count() == 2
    with pytest.raises(ValueError):
        exports.pinned_parquet(spark, str(file), "0" * 64, str(tmp_path / "shared"))
    runs = spark.createDataFrame([], exports.RUNS)
    assert lineage.recovery_queue(runs, 3).count() == 0 and all(spark.createDataFrame([], s).columns for s in (exports.RUN_EVENTS, exports.BUDGETS, exports.WORKFLOWS, exports.DATASET_VERSIONS))
    edges = spark.createDataFrame([("a", "b"), (None, "c"), ("b", None)], "src string, dst string")
    assert lineage.closure(edges, spark.createDataFrame([("a",)], "node string")).count() == 2
    held = exports.json_column(spark.createDataFrame([(1, "[" * 16 + "1" + "]" * 16), (2, "[" * 17 + "]" * 17), (3, None)], "i int, body string"), "body")
    assert {r["i"]: r["json_reason"] for r in held.select("i", F.col("json_reason")).collect()} == {1: None, 2: "depth", 3: "missing"}
