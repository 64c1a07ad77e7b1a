"""Formulas, funding, portfolio recurrence, statistics, streams, sources and exact numbers on hand-made inputs."""

import io
import json
import random
import zipfile
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.exact import fifty_digits, fits_96_bits, single_entry_nav, terminating
from tidemark.operators import alloc, formula, funding, ledger, lineage, pit, stats, study
from tidemark.operators.deliveries import SeenLedger
from tidemark.sources import artifacts, documents
from tidemark.streaming import events as stream


def test_formula(spark):
    df = spark.createDataFrame([(6.0, 3.0, [1.0, 4.0], [0.1, 0.2, -0.5]), (1.0, 0.0, [1.0, None], [0.1])], "a double, b double, p array<double>, s array<double>")
    columns = {c: F.col(c) for c in df.columns}
    text = "(a - 1) / b + delta(p) * -2 + compound_return(s, 2)"
    out = df.select(formula.compile_formula(text, columns).alias("v"), formula.zero_denominators(text, columns).alias("z")).collect()
    assert out[0]["v"] == pytest.approx(5 / 3 - 6 + (1.2 * 0.5 - 1)) and out[1]["v"] is None
    assert [r["z"] for r in out] == [False, True]
    assert formula.names(text) == {"a", "b", "p", "s"}
    assert formula.unit_of("x / y * z", {"x": "USD", "y": "shares", "z": "dimensionless"}) == (1, -1)
    with pytest.raises(formula.FormulaError):
        formula.unit_of("x + y", {"x": "USD", "y": "shares"})


@pytest.mark.parametrize("text", ["__import__('os')", "a ** 2", "a if b else c", "a[0]", "f(a)", "a.b", "delta(a + b)", "compound_return(a, 121)", "compound_return(a, 0)", "True", "a # b", "(" * 30 + "a" + ")" * 30 + "+", "é", "-" * 40 + "a"])
def test_formula_is_closed(text):
    with pytest.raises(formula.FormulaError):
        formula.parse(text)


def test_buckets_give_the_rest_to_the_low_ones(spark):
    df = spark.createDataFrame([("f", f"s{i}", float(i // 2), 1.0 + i) for i in range(8)] + [("f", "none", None, 1.0)], "formation string, security_id string, signal double, cap double")
    got = {r["security_id"]: r["bucket"] for r in alloc.buckets(df, 3).collect()}
    assert [got[f"s{i}"] for i in range(8)] == [0, 0, 0, 1, 1, 1, 2, 2] and "none" not in got
    totals = alloc.sleeve_totals(alloc.sleeve_weights(alloc.buckets(df, 3), 3, True)).first()
    assert totals["long_total"] == pytest.approx(1) and totals["short_total"] == pytest.approx(-1)


def test_post_fee_root_agrees_with_exact(spark):
    rng = random.Random(4)
    book = [(f"b{b}", f"s{i}", rng.choice([0.0, 0.25, -0.5, 0.125]), float(rng.randrange(-400, 400))) for b in range(12) for i in range(6)]
    df = spark.createDataFrame(book, "batch string, security_id string, weight double, old double")
    near = {r["batch"]: r["root"] for r in funding.post_fee_roots(df, 1000.0, 0.01).collect()}
    text = df.select("batch", F.format_string("%.3f", "weight").alias("weight"), F.format_string("%.1f", "old").alias("old"), F.lit("1000").alias("equity"), F.lit("0.01").alias("cost"))
    exact = {r["batch"]: r["num"] and int(r["num"]) / int(r["den"]) for r in funding.post_fee_roots_exact(text).collect()}
    assert len(near) == 12 and all(near[b] == pytest.approx(exact[b]) for b in near)
    for b, v in near.items():
        assert v + 0.01 * sum(abs(v * w - o) for x, _, w, o in book if x == b) == pytest.approx(1000)


def test_single_entry_is_a_root():
    nav = single_entry_nav(Fraction(1002), Fraction(1, 1000))
    assert nav + Fraction(1, 1000) * 2 * nav == 1002


def test_portfolio_pays_for_drift(spark):
    weights = spark.createDataFrame([("s", m, x, w) for m in ("2024-01", "2024-02") for x, w in (("A", 0.5), ("B", -0.5))], "signal string, month string, symbol string, weight double")
    forward = spark.createDataFrame([("A", "2024-01", 0.2), ("B", "2024-01", -0.1), ("A", "2024-02", 0.0), ("B", "2024-02", 0.0)], "symbol string, month string, forward double")
    got = {(r["cost_bps"], r["month"]): r for r in study.portfolio_net(weights, forward, (0, 100)).collect()}
    first = got[100, "2024-01"]
    assert first["turnover"] == pytest.approx(1.0) and first["net"] == pytest.approx(0.15 - 0.01)
    drift_a, drift_b = 0.5 * 1.2 / 1.14, -0.5 * 0.9 / 1.14
    turnover = abs(0.5 - drift_a) + abs(-0.5 - drift_b)
    assert got[100, "2024-02"]["turnover"] == pytest.approx(turnover) and got[100, "2024-02"]["fee"] == pytest.approx(0.01 * turnover + 0.01)
    assert got[0, "2024-02"]["net"] == pytest.approx(0.0)


def test_hac_of_a_ramp(spark):
    df = spark.createDataFrame([("r", i, float(i + 1)) for i in range(4)] + [("flat", i, 2.0) for i in range(4)], "series string, idx int, value double")
    got = {r["series"]: r for r in stats.hac_mean(df, 1).collect()}
    assert got["r"]["variance_mean"] == pytest.approx(0.390625) and got["r"]["t_statistic"] == pytest.approx(4.0)
    assert got["flat"]["t_statistic"] is None


def test_walk_forward_purges_what_was_known_late(spark):
    labels = spark.createDataFrame([("s", i, i * 10, i * 10 + (25 if i == 2 else 5)) for i in range(7)], "series string, idx bigint, start int, available int")
    got = {(r["fold"], r["idx"]): r["role"] for r in stats.walk_forward(labels, 3, 2).collect()}
    assert [got[0, i] for i in range(5)] == ["train", "train", "purged", "test", "test"]
    assert [got[1, i] for i in range(7)] == ["train"] * 5 + ["test"] * 2


def test_purge_and_embargo(spark):
    labels = spark.createDataFrame([("s", i, i * 10, i * 10 + 15) for i in range(8)], "series string, idx bigint, start int, end int")
    got = [r["role"] for r in stats.purged_fold(labels, 3, 4, 12).orderBy("idx").collect()]
    assert got == ["train", "train", "purged", "test", "test", "purged", "embargoed", "train"]


def test_active_intervals_count_both_ends(spark):
    iv = spark.createDataFrame([("k", 10, 20, 5), ("k", 20, 30, 7)], "key string, from_us bigint, through_us bigint, amount bigint")
    asks = spark.createDataFrame([(1, "k", 9), (2, "k", 10), (3, "k", 20), (4, "k", 30), (5, "k", 31), (6, "other", 15)], "request_id int, key string, t bigint")
    got = {r["request_id"]: (r["n_active"], r["total"]) for r in pit.active_intervals(asks, iv).collect()}
    assert got == {1: (0, 0), 2: (1, 5), 3: (2, 12), 4: (1, 7), 5: (0, 0), 6: (0, 0)}


def test_selection_ignores_what_became_known_later(spark):
    facts = spark.createDataFrame([("A", "c", None, "2024-01-31", v, "USD", k, s, r) for v, k, s, r in (("1", "2024-02-01", "a", 0), ("2", "2024-02-02", "b", 1), ("3", "2024-02-02", "a", 1), ("9", "2024-03-01", "a", 2), ("7", None, "a", 9))], "security_id string, concept string, period_start string, period_end string, value string, unit string, available_at string, source_id string, revision int")
    facts = facts.withColumns({c: F.col(c).cast("date") for c in ("period_start", "period_end")}).withColumn("available_at", F.col("available_at").cast("timestamp_ntz"))
    at = F.lit("2024-02-10").cast("timestamp_ntz")
    assert [(r["value"], r["source_id"]) for r in pit.select_facts(facts, at).collect()] == [("3", "a")]
    assert [(r["kind"], r["n"]) for r in pit.fact_conflicts(facts, at).collect()] == [("value", 2)]


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = {r["node"]: r["depth"] for r in lineage.closure(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_edges_of_documents(spark):
    ref = {"sha256": "h", "size_bytes": 3, "media_type": "m"}
    docs = spark.createDataFrame([(1, json.dumps({"a/b": [ref, {"x~": ref}]})), (2, "broken"), (3, None)], "doc_id int, body string")
    assert {(r["doc_id"], r["path"]) for r in lineage.extract_edges(docs).collect()} == {("1", "/a~1b/0"), ("1", "/a~1b/1/x~0")}


def test_claims_follow_the_shares_held(spark):
    held = spark.createDataFrame([("u", "A", 1, 10), ("u", "A", 5, 0), ("v", "A", 3, -4)], "account string, security_id string, t bigint, shares bigint")
    actions = spark.createDataFrame([("A", 7, 3, 9, 0.5), ("A", 8, 6, 9, 0.5)], "security_id string, action_id int, t bigint, pay_at bigint, per_share double")
    assert sorted((r["account"], r["action_id"], r["amount"]) for r in ledger.claims(held, actions).collect()) == [("u", 7, 5.0), ("v", 7, -2.0), ("v", 8, -2.0)]


def test_stream_is_deduped_over_batches(spark, tmp_path):
    source, schema = tmp_path / "in", "delivery_id bigint, received_at timestamp, event_id string, payload string"
    seen = SeenLedger(spark, f"file://{tmp_path}/seen", 2)
    for part, ids in enumerate(([1, 2, 3], [2, 3, 4], [4, 1])):
        spark.createDataFrame([(part * 10 + i, None, f"e{i}", "{}") for i in ids], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream.dedupe_stream(spark.readStream.schema(schema).parquet(str(source)), seen, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(r["delivery_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [1, 2, 3, 14]
    spark.createDataFrame([(1, None, "e1", "{}"), (99, None, "e2", '{"other": 1}')], schema).coalesce(1).write.mode("append").parquet(str(source))
    again = lambda how: stream.dedupe_stream(spark.readStream.schema(schema).parquet(str(source)), seen, str(tmp_path / "out"), str(tmp_path / "cp"), conflicts=how)
    with pytest.raises(Exception, match="another payload"):
        again("raise").awaitTermination()
    again("keep").awaitTermination()
    assert sorted(r["delivery_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == got
    assert [r["delivery_id"] for r in spark.read.parquet(str(tmp_path / "out-conflicts")).collect()] == [99]


def test_admission_of_events(spark):
    e = spark.createDataFrame([("a", "x"), ("b", "changed"), ("c", "y")], "event_id string, payload string")
    inventory = spark.createDataFrame([("a", "x"), ("b", "z")], "event_id string, payload string").select("event_id", F.sha2(F.encode("payload", "utf-8"), 256).alias("sha256"))
    assert {r["event_id"]: r["admitted"] for r in stream.admit(e, inventory).collect()} == {"a": True, "b": False, "c": False}


def test_artifacts(spark, tmp_path):
    ref = artifacts.put(str(tmp_path), b"hello", "text/plain")
    assert artifacts.put(str(tmp_path), b"hello", "text/plain") == ref and artifacts.get(str(tmp_path), ref) == b"hello"
    refs = spark.createDataFrame([(ref["sha256"], 5), (ref["sha256"], 6), ("0" * 64, 1)], "sha256 string, size_bytes bigint")
    assert sorted((r["size_bytes"], r["status"]) for r in artifacts.verify(spark, str(tmp_path), refs).collect()) == [(1, "missing"), (5, "verified"), (6, "mismatch")]
    declared = spark.createDataFrame([("a", "1", 3), ("b", "2", 3), ("c", "3", 3)], "object string, sha256 string, rows bigint")
    actual = spark.createDataFrame([("a", "1", 3), ("b", "9", 3), ("d", "4", 1)], "object string, sha256 string, rows bigint")
    assert {r["object"]: r["status"] for r in artifacts.admission(declared, actual).collect()} == {"a": "admitted", "b": "changed", "c": "missing", "d": "undeclared"}


def test_json_sources(spark, tmp_path):
    fact = {"security_id": "A", "concept": "c", "period_start": None, "period_end": "2024-01-31", "value": "1.50", "unit": "USD", "available_at": "2024-02-01T00:00:00Z", "source_id": "s", "revision": 0}
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": "v1", "facts": [fact], "membership": []}))
    out = documents.monthly_source(spark, str(tmp_path / "m.json"))
    assert out["facts"].first()["value"] == "1.50" and out["membership"].count() == 0
    (tmp_path / "c.json").write_text(json.dumps({"chart": {"result": [{"meta": {"symbol": "X"}, "timestamp": [1704153600, 1704240000], "indicators": {"adjclose": [{"adjclose": [10.0, -1.0]}]}}]}}))
    panel = documents.chart_panel(spark, str(tmp_path / "c.json"))
    assert [str(r["date"]) for r in panel.orderBy("date").collect()] == ["2024-01-02", "2024-01-03"]
    assert [r["reason"] for r in documents.panel_violations(panel).collect()] == ["price"]
    (tmp_path / "k.json").write_text(json.dumps({"tag": "Assets", "units": {"USD": [{"end": "2023-12-31", "val": 5, "accn": "n", "filed": "2024-02-01"}]}}))
    assert documents.company_concept(spark, str(tmp_path / "k.json"), "USD", "A").first()["value"] == "5"
    documents.write_panel(panel, str(tmp_path / "panel"), 2)
    documents.write_ndjson(panel.select("symbol"), str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "panel")).count() == 2
    texts = spark.createDataFrame([(1, "a\fb\fc")], "doc_id int, text string")
    assert [(r["page"], r["text"]) for r in documents.pages(texts, [1, 3]).collect()] == [(1, "a"), (3, "c")]


def test_factor_archive(spark):
    def packed(text):
        with zipfile.ZipFile(data := io.BytesIO(), "w") as z:
            z.writestr("f.csv", text)
        return data.getvalue()

    good = "About this file\n\n,Mkt,RF\n20240102, 1.50, 0.02\n20240103,-0.50, 0.02\n\nCopyright\n"
    assert {(str(r["date"]), r["factor"], r["value"]) for r in documents.factor_archive(spark, packed(good)).collect()} == {("2024-01-02", "Mkt", 0.015), ("2024-01-02", "RF", 0.0002), ("2024-01-03", "Mkt", -0.005), ("2024-01-03", "RF", 0.0002)}
    for bad in (good.replace("-0.50", "-99.99"), good.replace("20240103", "20240102")):
        with pytest.raises(ValueError):
            documents.factor_archive(spark, packed(bad))


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', '{"a":NaN}', '{"a":1e999}', "[" * 17 + "]" * 17, "{", '"' + "x" * 40_000 + '"'])
def test_strict_json_refuses(text):
    with pytest.raises(ValueError):
        documents.strict_json(text)


@given(st.integers(-(10**12), 10**12), st.integers(0, 12), st.integers(0, 12))
@settings(max_examples=60, deadline=None)
def test_terminating_decimals(n, twos, fives):
    value = Fraction(n, 2**twos * 5**fives)
    assert Fraction(terminating(value)) == value


def test_exact_numbers():
    assert terminating(Fraction(1, 3)) is None and terminating(Fraction(1, 8)) == "0.125" and terminating(Fraction(-3)) == "-3"
    assert str(fifty_digits(Fraction(1, 3))) == "0." + "3" * 50
    assert fits_96_bits("79228162514264337593543950335") and not fits_96_bits("79228162514264337593543950336") and not fits_96_bits("1e-29")
