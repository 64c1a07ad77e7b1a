"""Queries of guards, exact numbers, grading, exports and saved state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import alloc, calendar, exactness, funding, grading, guards, ledger, lineage, retrieval
from tidemark.plans.records import _HITS, _hits
from tidemark.plans.selection import _BOOK, _MEMBERS, _PLAN, _SESS, _SLEEVES, _VALUES, _book, _cross_section, _line_facts, _membership, _sessions, _sleeves, _values
from tidemark.plans.study import rounded
from tidemark.sources import artifacts, exports
from tidemark.streaming import events as stream
from tidemark.tables import load, micros


def decision_time_violations(spark: SparkSession, d: str) -> DataFrame:
    return guards.decision_times(load(spark, d, "formations").distinct()).groupBy("reason").agg(F.count("*").alias("n"), F.min("formation_id").alias("first_id"))


def decision_order_violations(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as decisions, formed when ordered and traded when shipped."""
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", F.col("o_orderdate").alias("formation_at"), F.col("l_shipdate").alias("trade_at"))
    return guards.decision_times(rows).groupBy("l_orderkey", "reason").agg(F.count("*").alias("n"))


def economic_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "formations").filter("formation_at is not null").select("formation_id", "formation_at").distinct()
    return rows.select("formation_id", *[guards.economic_cutoff(F.col("formation_at"), m).alias(f"lag_{m}") for m in (1, 6, 13)])


def line_content_conflicts(spark: SparkSession, d: str) -> DataFrame:
    facts = _line_facts(spark, d).withColumn("period_end", F.trunc("period_end", "year")).filter("security_id is not null")
    return guards.content_conflicts(facts, F.lit("1999-06-30").cast("timestamp_ntz")).groupBy("kind", "concept").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n"))


def membership_conflicts_all(spark: SparkSession, d: str) -> DataFrame:
    """Events as memberships whose number is their place within the user's day, so that numbers come again."""
    m = _membership(spark, d)
    return guards.membership_violations(m.withColumn("event_id", F.pmod("event_id", F.lit(7))).withColumns({c: F.to_date(c) for c in ("effective_at", "available_at")}))


def signal_usability(spark: SparkSession, d: str) -> DataFrame:
    return guards.usable_signals(_values(spark, d), {"A": 5, "R": 6})


def impossible_values(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "quotes").select(F.when(F.col("phase") == "open", "ret").otherwise("cap").alias("concept"), F.col("price_usd").alias("value"), "source_id").distinct()
    return guards.value_violations(rows, ["ret"], ["cap"]).groupBy("reason").agg(F.count("*").alias("n"), F.min("source_id").alias("first_source"))


def phase_marks(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "quotes")
    asked = q.filter("observed_at is not null and security_id is not null").select("security_id", F.col("observed_at").alias("at")).distinct()
    asked = asked.select(F.concat_ws("@", "security_id", F.col("at").cast("string")).alias("request_id"), "security_id", "at", F.lit("close").alias("phase"), F.col("security_id").like("%7").alias("required"))
    return guards.required_marks(asked, q).groupBy("security_id", "status").agg(F.count("*").alias("n"), F.min("source_id").alias("first_source"))


def loan_cover(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "borrow_grants").filter("security_id is not null and valid_from is not null and valid_through is not null and available_at is not null and source_id is not null")
    grants = g.select("source_id", "security_id", micros(g, "available_at").alias("known_us"), micros(g, "valid_from").alias("from_us"), micros(g, "valid_through").alias("through_us"), F.coalesce(F.expr("try_cast(maximum_short_shares as bigint)"), F.lit(0).cast("bigint")).alias("amount"))
    f = load(spark, d, "formations").filter("trade_at is not null and security_id is not null")
    asked = f.select(F.col("formation_id").alias("request_id"), "security_id", micros(f, "trade_at").alias("t"), F.lit(-300).cast("bigint").alias("quantity")).distinct()
    return guards.covering_loans(asked, grants).withColumn("n", F.col("n").cast("bigint"))


def required_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    need = p.select(F.col("p_brand").alias("dataset"), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int").alias("lag_months"), F.col("p_size").alias("history_months"))
    required = guards.required_start(need, F.lit("1997-03-31"))
    have = p.groupBy(F.col("p_brand").alias("dataset")).agg(F.date_add(F.lit("1992-11-01").cast("date"), F.max("p_size") * 2).alias("first_day")).filter("dataset not like '%1'")
    return required.join(guards.coverage_gaps(required, have), "dataset", "left")


def session_checks(spark: SparkSession, d: str) -> DataFrame:
    """Order days of each nation as its sessions, from the first to the last order by time of day, some turned round."""
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    by = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("calendar_id"), F.to_date("o_orderdate").alias("session_date")).agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    day = F.unix_date("session_date").cast("bigint") * 86_400_000_000
    rows = by.select("calendar_id", "session_date", (day + F.col("b") * 1_000_000).alias("opens_us"), (day + F.col("a") * 2_000_000).alias("closes_us"))
    return guards.session_violations(rows)


def late_calendars(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "sessions").filter("calendar_id is not null and session_date is not null")
    formed = calendar.month_ends(_sessions(spark, d)).select("calendar_id", (F.unix_date("session_date").cast("bigint") * 86_400_000_000).alias("formed_us"))
    known = s.select("calendar_id", micros(s, "available_at").alias("known_us")).filter("known_us is not null")
    return guards.known_calendars(formed, known.withColumn("known_us", F.col("known_us") + 90 * 86_400_000_000))


def execution_schedule(spark: SparkSession, d: str) -> DataFrame:
    s = _sessions(spark, d)
    return guards.execution_schedule(calendar.formation_plan(s, 2), s, F.lit("2021-01-01").cast("date"), F.lit("2022-12-30").cast("date"))


def sleeve_violations(spark: SparkSession, d: str) -> DataFrame:
    """The sleeves of each month, those of some months spoilt."""
    w = _sleeves(spark, d, True)
    spoilt = w.withColumn("weight", F.when(F.col("formation").like("%-05"), F.col("weight") * 1.5).otherwise(F.col("weight"))).withColumn("bucket", F.when(F.col("formation").like("%-08") & (F.col("bucket") == 2), 1).otherwise(F.col("bucket")))
    spoilt = spoilt.unionByName(w.filter("formation like '%-11' and bucket = 2"))
    return guards.partition_violations(spoilt, 5)


def portfolio_identities(spark: SparkSession, d: str) -> DataFrame:
    w = alloc.sleeve_weights(alloc.buckets(_cross_section(spark, d), 5, 2), 5, False)
    return guards.portfolio_targets(w.select("formation", "security_id", "weight"), "0" * 64).select("formation", "portfolio_id").distinct()


def component_checks(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    return guards.component_disagreements(p.select(F.col("p_partkey").alias("part"), F.substring("p_brand", 1, 7).alias("environment"), F.col("p_type").alias("binding"), F.pmod("p_partkey", F.lit(2)).alias("definition")))


def solvency_path(spark: SparkSession, d: str) -> DataFrame:
    """Customers' balances less what they ordered so far."""
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"])
    w = ledger.Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(ledger.Window.unboundedPreceding, 0)
    path = rows.select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("at"), F.when(F.col("o_orderkey") % 100 != 3, F.col("c_acctbal") * 200 - F.sum("o_totalprice").over(w)).alias("nav"))
    return guards.solvency(path)


def whole_share_rebalance(spark: SparkSession, d: str) -> DataFrame:
    """The book of each month at its root, in whole shares of prices that rise with the nation's number."""
    book = _book(spark, d)
    roots = funding.post_fee_roots(book, 1_000_000.0, 0.001)
    price = F.substring("security_id", 2, 2).cast("int") * 12_000 + 75_000
    rows = book.join(roots, "batch").select("batch", "security_id", F.round("weight", 6).alias("weight"), F.floor(F.col("old") / price).cast("bigint").alias("old_shares"), price.cast("double").alias("price"), F.lit(1_000_000.0).alias("nav_before"), F.round("root", 2).alias("root"))
    return rounded(guards.rebalance(rows, 0.001), "nav", "turnover", "fees", "long", "short", places=2)


def rebalance_trades(spark: SparkSession, d: str) -> DataFrame:
    book = _book(spark, d)
    held = book.select(F.col("batch"), "security_id", "old").unionByName(book.select("batch", F.lit("GONE").alias("security_id"), F.lit(1234.5).alias("old")).distinct())
    return rounded(guards.trades(book.select("batch", "security_id", "weight"), held, funding.post_fee_roots(book, 1_000_000.0, 0.001)), "target", "trade", places=2)


FORMULA = "(quantity * 3 - line / 8) * 2 + delta(pair) - 0.125"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"), F.col("l_partkey").alias("p")).distinct()


def _formula_inputs() -> dict:
    text = lambda c: F.col(c).cast("string")
    return {"quantity": text("q"), "line": text("n"), "pair": F.array(text("n"), text("p"))}


def formula_fifty_digits(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("k", "n", "q", "p", exactness.formula_column(FORMULA, _formula_inputs())["value"].alias("value"))


def formula_refusals(spark: SparkSession, d: str) -> DataFrame:
    """A square over what lies between a quantity and ten: too large, without a value, or over zero, whatever comes first."""
    rows = _lines(spark, d)
    columns = {"q": F.when(F.col("q") != 13, F.col("q").cast("string")), "p": F.concat(F.lit("1e"), (F.col("p") % 60).cast("string"))}
    out = rows.select(exactness.formula_column("p * p / (q - 10)", columns).alias("r"))
    return out.groupBy("r.reason").agg(F.count("*").alias("n"))


def formula_rationals(spark: SparkSession, d: str) -> DataFrame:
    columns = {"a": F.col("q").cast("string"), "b": F.col("p").cast("string"), "c": F.col("n").cast("string")}
    return _lines(spark, d).select("k", "n", "q", "p", exactness.formula_column("a / b - c", columns, True)["value"].alias("value"))


def formula_equivalence(spark: SparkSession, d: str) -> DataFrame:
    cases = [("same", "a * (b + c)", "a * b + a * c"), ("other", "a - b", "b - a"), ("zero", "a / (b - b)", "c / (b - b)"), ("broken", "a", "a +* b"), ("sign", "-(a - b)", "b - a")]
    vectors = _lines(spark, d).select(F.col("q").cast("string").alias("a"), F.col("p").cast("string").alias("b"), F.col("n").cast("string").alias("c"))
    return exactness.equivalent_formulas(cases, vectors)


def terminating_quotients(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("k", "n", "q", "p", exactness.terminating_column(F.col("q"), F.col("n")).alias("value"))


def exact_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Prices as they are written, ranked as numbers within their phase."""
    q = load(spark, d, "quotes").select(F.col("phase").alias("formation"), F.col("source_id").alias("security_id"), F.col("price_usd").alias("signal")).distinct()
    out = exactness.exact_ordinals(q.filter("formation is not null"))
    return out.groupBy("formation").agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("distinct"), F.min_by("signal", F.struct("ordinal", F.length("signal"), "signal")).alias("least"), F.max("ordinal").alias("last"))


def wide_decimals(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "part").select("p_partkey", F.concat(F.repeat(F.lit("9"), F.pmod("p_partkey", F.lit(31)).cast("int") + 1), F.lit("."), F.repeat(F.lit("1"), F.pmod("p_partkey", F.lit(29)).cast("int") + 1)).alias("value"))
    return rows.select("p_partkey", exactness.fits_96_bits_column(F.col("value")).alias("fits"))


def entry_values(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("cash"), F.concat(F.lit("0.000"), F.pmod("p_partkey", F.lit(9)).cast("string")).alias("rate"))
    return rows.select("p_partkey", exactness.single_entry_column(F.col("cash"), F.col("rate")).alias("value"))


def judgment_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Nations' customers judged by segment and quarter, against a collection that lacks one segment and has one of its own."""
    c = load(spark, d, "customer")
    judged = c.filter("c_acctbal > 3000").select(F.col("c_nationkey").alias("query_id"), F.concat_ws(":", "c_mktsegment", F.pmod("c_custkey", F.lit(4))).alias("doc_id"))
    docs = c.select(F.concat_ws(":", F.when(F.col("c_mktsegment") == "MACHINERY", "NEW").otherwise(F.col("c_mktsegment")), F.pmod("c_custkey", F.lit(4))).alias("doc_id"))
    return grading.judgment_coverage(c.select(F.col("c_nationkey").alias("query_id")), docs, judged)


def source_selection(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "corpus").filter("text is not null and length(text) > 1200").select(F.col("paper_id").alias("doc_id"), F.concat(F.lit("packet-"), "paper_id").alias("packet_id"))
    return grading.selected_sources(_hits(spark, d, 10), docs, 10)


def direction_grading(spark: SparkSession, d: str) -> DataFrame:
    """Papers as cases: their first three words are the anchors, reviews quote the text's beginning, some wrongly."""
    p = load(spark, d, "corpus").filter("text is not null and title is not null").groupBy("paper_id").agg(F.min("text").alias("text"))
    body = retrieval.normalize(F.col("text"))
    number = F.pmod(F.length("text"), F.lit(5))
    cases = p.select(F.col("paper_id").alias("case_id"), F.col("text").alias("source"), F.when(number != 4, "long").alias("expected"), F.slice(F.split(body, " "), 1, 3).alias("anchors"))
    reviews = p.select(F.col("paper_id").alias("case_id"), F.when(number == 4, "uncertain").otherwise("supported").alias("status"), F.when(number == 1, "short").when(number != 4, "long").alias("direction"), F.when(number != 4, F.substring(body, 1, 60)).alias("quote"), F.when(number == 2, 2).when(number != 4, 1).alias("page"))
    return grading.direction_grades(cases, reviews.filter("case_id not like '%3'"))


def batch_grading(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    cases = o.select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("request"))
    checks = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100_000))
    given = o.filter("o_orderkey % 5 <> 2").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 7 == 1, -1).otherwise(F.col("o_custkey")).alias("request"), checks.alias("checks"))
    out = grading.batch_evaluation(cases, given)
    return out.groupBy("evidence", "passed").agg(F.count("*").alias("n"), F.sum("case_id").alias("ids"))


def candidate_statuses(spark: SparkSession, d: str) -> DataFrame:
    p, li = load(spark, d, "part"), load(spark, d, "lineitem")
    sources = p.select((F.col("p_partkey") * 2).alias("position"), F.col("p_partkey").alias("source_id"), F.pmod("p_partkey", F.lit(50)).alias("packet"))
    bindings = li.filter("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("source_id"), F.pmod("l_suppkey", F.lit(50)).alias("packet"))
    seen = li.filter("l_discount > 0.05").select(F.col("l_partkey").alias("source_id"), (F.col("l_linestatus") == "O").alias("reviewed"))
    return grading.candidate_status(sources, bindings.unionByName(sources.filter("source_id % 3 = 0").select("source_id", "packet")), seen)


def synthesis_weights(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders as allocations of one over their number, some with one too many, a zero or a name twice."""
    o = load(spark, d, "orders")
    n = F.count("*").over(ledger.Window.partitionBy("o_custkey"))
    i = F.row_number().over(ledger.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = o.select(F.col("o_custkey").alias("synthesis_id"), F.when((F.col("o_custkey") % 11 == 3) & (i == 2), 1).otherwise(i).alias("source_id"), F.when((F.col("o_custkey") % 13 == 5) & (i == 1), 0).when((F.col("o_custkey") % 7 == 1) & (i == 1), 2).otherwise(1).alias("numerator"), n.alias("denominator"))
    return grading.weight_violations(rows)


def synthesis_grades(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("completed"), (F.col("o_totalprice") > 50_000).alias("weights"), F.when(F.col("o_orderkey") % 9 != 4, F.col("o_orderpriority") != "5-LOW").alias("citations"))
    return grading.conjoined(o, "o_orderkey", ["completed", "weights", "citations"])


def metadata_search(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "corpus").select(F.col("paper_id").alias("doc_id"), "title", F.concat(F.lit("10.1/"), "paper_id").alias("identifier"))
    return grading.metadata_matches(p, "momentum", "10.1/PAPER-00-000005", 50)


def strict_json_reasons(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "quote_events").select("delivery_id", "payload").distinct()
    spoilt = q.withColumn("payload", F.when(F.col("delivery_id") % 10 == 1, F.concat(F.lit('{"a":1,"a":'), "payload", F.lit("}"))).when(F.col("delivery_id") % 10 == 2, F.concat(F.lit('{"x":NaN,"y":'), "payload", F.lit("}"))).when(F.col("delivery_id") % 10 == 3, F.concat("payload", F.lit("]"))).when(F.col("delivery_id") % 10 == 4, F.concat(F.repeat(F.lit("["), 17), F.lit("1"), F.repeat(F.lit("]"), 17))).otherwise(F.col("payload")))
    return exports.json_column(spoilt, "payload").groupBy("json_reason").agg(F.count("*").alias("n"), F.min("delivery_id").alias("first_id"))


def operation_trajectories(spark: SparkSession, d: str) -> DataFrame:
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    ops = o.select(F.col("o_orderkey").alias("operation_id"), F.col("o_orderpriority").alias("kind"))
    tries = li.select(F.col("l_orderkey").alias("operation_id"), F.concat_ws("-", "l_linenumber", F.lpad("l_partkey", 9, "0"), F.lpad("l_suppkey", 9, "0"), F.col("l_quantity").cast("int")).alias("attempt_no"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("outcome")).distinct()
    return lineage.trajectories(ops, tries).groupBy("kind", "status").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("attempts"), F.lit(0))).alias("attempts"))


def orders_containing(spark: SparkSession, d: str) -> DataFrame:
    return lineage.containing(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("root"), F.col("l_partkey").cast("string").alias("artifact")), "5")


def closure_checks(spark: SparkSession, d: str) -> DataFrame:
    """Parts as artifacts: order lines refer to them with a size, of which some differ; small parts are not stored."""
    li, p = load(spark, d, "lineitem"), load(spark, d, "part")
    reached = li.filter("l_suppkey % 7 = 2").select(F.col("l_partkey").alias("node")).distinct()
    refs = li.select(F.col("l_partkey").alias("node"), F.when((F.col("l_partkey") % 10 == 0) & (F.col("l_linenumber") > 4), 1).otherwise(2).alias("size_bytes"), F.lit("m").alias("media_type"))
    stored = p.filter("p_size > 5").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 9 == 4, 3).otherwise(2).alias("size_bytes"))
    return lineage.closure_violations(reached, refs, stored)


def owner_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select(F.col("o_orderstatus").alias("name"), F.concat(F.lit("u"), F.lpad("o_custkey", 7, "0")).alias("owner"), (F.col("o_orderpriority") == "1-URGENT").alias("shared")).distinct()
    mine = lineage.owned_or_shared(rows.filter("owner like '%3'"), "name", "F", "u0000013")
    return mine.unionByName(lineage.owned_or_shared(rows.filter("owner like '%4' and shared"), "name", "P", "nobody"))


def recovery_order(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    runs = docs.select(F.col("doc_id").alias("run_id"), F.when(F.col("content_kind") == "research_note", "RECEIVED").otherwise("DONE").alias("status"), F.col("available_at").alias("last_recovery_at"), F.col("n_chars").alias("created_at"))
    return lineage.recovery_queue(runs, 40).select("run_id", "last_recovery_at")


def event_history(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    n = F.row_number().over(ledger.Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), n.alias("version"), F.col("event_type").alias("state"), "event_id").filter("event_id % 97 <> 5")
    out = lineage.event_histories(rows)
    return out.select("run_id", F.concat_ws(",", "states").alias("states"), "contiguous")


def order_page(spark: SparkSession, d: str) -> DataFrame:
    return lineage.page(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 300, 100)


def scheduler_outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    candidates = o.select(F.col("o_orderkey").alias("candidate_id"), (F.col("o_orderstatus") != "P").alias("ready"), "o_orderpriority")
    results = o.filter("o_orderkey % 6 <> 1").select(F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_totalprice") > 50_000, F.col("o_totalprice")).alias("nav"))
    out = lineage.outcomes(candidates, results, o.filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("candidate_id")))
    return out.groupBy("o_orderpriority", "status").agg(F.count("*").alias("n"))


def research_reports(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    key = F.col("o_orderkey").alias("candidate_id")
    k = F.col("o_orderkey")
    results = o.filter(k % 10 != 3).select(key, F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), F.col("o_totalprice").alias("nav"))
    reviews = o.filter(k % 4 != 1).select(key, (F.col("o_orderpriority") != "5-LOW").alias("direction_agrees"))
    checked = o.filter(k % 3 != 2).select(key, F.when(k % 5 == 0, "SHORT").alias("reason"))
    out = lineage.report(o.select(key, F.col("o_custkey").alias("source")), results, reviews, checked)
    return out.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("candidate_id").alias("ids"))


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return exports.upsert(p.filter("p_partkey % 4 <> 0"), p.filter("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + 100), "p_partkey")


def content_identities(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").select("p_partkey", "p_brand")
    return p.select("p_partkey", exports.content_id("p_brand", "p_partkey").alias("content_id"))


def version_publishing(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").select(F.col("p_brand").alias("dataset_id"), F.col("p_type").alias("version_sha256"), F.when(F.col("p_partkey") % 2 == 0, "x").otherwise("y").alias("body"), "p_size")
    new, wrong = exports.publish_versions(p.filter("p_size < 10").drop("p_size"), p.filter("p_size between 8 and 14").drop("p_size"))
    return new.withColumn("outcome", F.lit("append")).unionByName(wrong.withColumn("body", F.lit(None).cast("string")).withColumn("outcome", F.lit("conflict")))


def graph_export(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    edges = li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.concat(F.lit("/lines/"), F.col("l_linenumber").cast("string")).alias("path"), F.lit("part").alias("media_type"))
    nodes, links = exports.graph_tables(edges)
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).unionByName(links.agg(F.lit("edge").alias("kind"), F.count("*").alias("n")))


def graph_readback(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").select("p_partkey", "p_brand")
    return exports.readback(p.filter("p_partkey % 40 <> 7"), p.filter("p_partkey % 50 <> 9"))


def metric_export(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").withColumn("ratio", F.try_divide("s_acctbal", F.col("s_suppkey") % 5))
    return rounded(exports.metric_rows(s, "s_suppkey", ["s_acctbal", "ratio"]), "value")


def gauge_export(spark: SparkSession, d: str) -> DataFrame:
    return exports.gauges(load(spark, d, "documents"), "lang", "documents")


def trace_export(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    ops = e.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("operation_id"), F.col("event_type").alias("kind"), F.col("ts").alias("started_at"), F.when(F.col("event_id") % 50 != 3, F.col("ts") + F.expr("interval 1 minute")).alias("ended_at"))
    return exports.trace_runs(ops)


def span_export(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), F.col("event_type").alias("name"), F.lit(1).alias("started_at"), F.lit(2).alias("ended_at"))
    return exports.span_lines(e)


def job_queue(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    jobs = o.select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("job_id"), F.floor(F.col("o_orderkey") / 3).alias("dedupe_id"), F.col("o_orderdate").alias("sent_at"))
    return exports.next_jobs(jobs, o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id")))


def cache_freshness(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", F.col("available_at").alias("retrieved_at"))
    return exports.fresh(docs, F.lit("2022-01-15 12:00:00").cast("timestamp_ntz"), 24 * 60)


def discovery_replay(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as one saved search answer, of which the items are the events in order."""
    e = load(spark, d, "events")
    item = F.struct(F.concat(F.lit("10.1/"), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))).alias("DOI"), F.array(F.col("event_id").cast("string")).alias("title"))
    body = e.groupBy(F.col("user_id").alias("answer_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", item.alias("i")))), lambda x: x["i"]).alias("items"))
    return exports.discovery_hits(body.select("answer_id", F.to_json(F.struct(F.struct("items").alias("message"))).alias("body")))


def dataset_admission(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("object"), F.col("p_brand").alias("sha256"), F.col("p_size").cast("bigint").alias("rows"))
    actual = p.filter("object not like '%7'").withColumn("sha256", F.when(F.col("object").like("%3"), "changed").otherwise(F.col("sha256"))).withColumn("rows", F.when(F.col("object").like("%5"), F.lit(0)).otherwise(F.col("rows")))
    return artifacts.admission(p.filter("object not like '%9'"), actual)


def stream_admission(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries against an inventory of those of whole tens; the bytes of some differ."""
    q = load(spark, d, "quote_events").filter("payload is not null").select(F.col("delivery_id").cast("string").alias("event_id"), "payload").distinct()
    inventory = q.filter("event_id like '%0'").select("event_id", F.sha2(F.encode(F.when(F.col("event_id").like("%50"), F.concat("payload", F.lit(" "))).otherwise(F.col("payload")), "utf-8"), 256).alias("sha256"))
    return stream.admit(q, inventory).groupBy("admitted").agg(F.count("*").alias("n"))


def production_order(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "quotes").filter("source_id is not null and observed_at is not null and security_id is not null").select("source_id", "security_id", "observed_at").distinct()
    return exports.bounded_production(q, 500)


_LINES = "lines as (select distinct l_orderkey k, l_linenumber n, cast(l_quantity as bigint) q, l_partkey p from lineitem)"
_ROOTS = _BOOK + """, ok as (select batch from book group by batch having 0.001 * sum(abs(w)) < 1 and 0.001 * sum(abs(o)) < 1000000),
    brk as (select distinct batch, o / w b from book where w <> 0 and o / w > 0 and o / w < 1000000 union select batch, 0.0 from ok), seg as (select batch, b a, coalesce(lead(b) over (partition by batch order by b), 1000000.0) z from brk),
    aff as (select batch, a, z, sum(case when (a + z) / 2 * w >= o then w else -w end) sw, sum(case when (a + z) / 2 * w >= o then o else -o end) so from seg join book using (batch) group by batch, a, z),
    r as (select batch, a, (1000000 + 0.001 * so) / (1 + 0.001 * sw) v, z from aff), roots as (select batch, arg_min(v, a) root from r join ok using (batch) where v >= a - 1e-9 and v <= z + 1e-9 group by batch)"""
_TRIM = "regexp_replace(regexp_replace(cast({} as varchar), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
_RATIO = "cast({0} // gcd({0}, {1}) as varchar) || '/' || cast({1} // gcd({0}, {1}) as varchar)"

SQL = {
    "decision_time_violations": """with f as (select distinct * from formations) select 'clock_missing' reason, count(*) n, min(formation_id) first_id from f where formation_at is null or trade_at is null having count(*) > 0
        union all select 'not_before_trade', count(*), min(formation_id) from f where formation_at >= trade_at having count(*) > 0""",
    "decision_order_violations": "select l_orderkey, 'not_before_trade' reason, count(*) n from lineitem join orders on l_orderkey = o_orderkey where o_orderdate >= l_shipdate group by 1",
    "economic_cutoffs": "select distinct formation_id, cast(cast(formation_at as date) - interval 1 month as date) lag_1, cast(cast(formation_at as date) - interval 6 month as date) lag_6, cast(cast(formation_at as date) - interval 13 month as date) lag_13 from formations where formation_at is not null",
    "line_content_conflicts": """with k as (select 'S' || l_suppkey s, l_returnflag c, date_trunc('year', o_orderdate) e, cast(l_extendedprice as decimal(15, 2)) v, l_shipdate a, 'L' || l_partkey src, l_linenumber r from lineitem join orders on l_orderkey = o_orderkey where l_shipdate <= timestamp '1999-06-30'),
        x as (select 'content' kind, c concept, count(distinct (v, a)) n from k group by s, c, e, src, r having n > 1 union all select 'value', c, count(distinct v) n from k group by s, c, e, a, r having n > 1) select kind, concept, count(*) n_keys, cast(sum(n) as bigint) n from x group by 1, 2""",
    "membership_conflicts_all": f"""with {_MEMBERS}, m as (select security_id, event_id % 7 e, included i, cast(effective_at as date) a, cast(available_at as date) b from members)
        select 'event' reason, security_id, count(distinct (i, a, b)) n from m group by security_id, e having n > 1 union all select 'included', security_id, count(distinct i) n from m group by security_id, a, b having n > 1""",
    "signal_usability": _VALUES + """, w as (select security_id, concept, count(v) >= case concept when 'A' then 5 else 6 end ok from filled group by 1, 2) select security_id, count(*) filter (ok) = 2 usable, 2 - count(*) filter (ok) incomplete from w group by 1""",
    "impossible_values": """with v as (select distinct case when phase = 'open' then 'ret' else 'cap' end c, price_usd p, source_id s, try_cast(price_usd as decimal(38, 12)) x from quotes) select 'return_below_minus_one' reason, count(*) n, min(s) first_source from v where c = 'ret' and x < -1 having count(*) > 0
        union all select 'capitalization_not_positive', count(*), min(s) from v where c = 'cap' and x <= 0 having count(*) > 0 union all select 'no_number', count(*), min(s) from v where p is not null and x is null having count(*) > 0""",
    "phase_marks": """with a as (select distinct security_id s, observed_at t from quotes where security_id is not null and observed_at is not null), k as (select security_id s, observed_at t, min(struct_pack(a := source_id, p := price_usd)) q from quotes where available_at <= observed_at and phase = 'close' group by 1, 2)
        select s security_id, case when q.p is not null then 'marked' when s like '%7' then 'refused' else 'unmarked' end status, count(*) n, min(q.a) first_source from a left join k using (s, t) group by 1, 2""",
    "loan_cover": """with g as (select distinct source_id, security_id, greatest(valid_from, available_at) a, valid_through b, coalesce(try_cast(maximum_short_shares as bigint), 0) m from borrow_grants where security_id is not null and valid_from is not null and valid_through is not null and available_at is not null and source_id is not null),
        f as (select distinct formation_id, security_id, trade_at t from formations where trade_at is not null and security_id is not null), j as (select formation_id, f.security_id, t, count(g.source_id) n from f left join g on g.security_id = f.security_id and t between a and b and m >= 300 group by all)
        select formation_id request_id, security_id, n, case n when 0 then 'missing' when 1 then 'covered' else 'ambiguous' end status from j""",
    "required_coverage": """with r as (select p_brand dataset, cast(min(date_trunc('month', date '1997-03-31' - to_months(cast(p_partkey % 5 + 1 + p_size - 1 as int)))) as date) starts_on from part group by 1),
        c as (select p_brand dataset, date '1992-11-01' + cast(max(p_size) * 2 as int) f from part group by 1) select r.dataset, starts_on, case when f > starts_on then cast(f - starts_on as int) end "days" from r left join (select * from c where dataset not like '%1') using (dataset)""",
    "session_checks": """with b as (select c_nationkey calendar_id, cast(o_orderdate as date) session_date, min(o_orderkey) a, max(o_orderkey) z from orders join customer on o_custkey = c_custkey group by 1, 2),
        s as (select calendar_id, session_date, (session_date - date '1970-01-01') * 86400000000 + z * 1000000 o, (session_date - date '1970-01-01') * 86400000000 + a * 2000000 c from b), w as (select *, lag(c) over (partition by calendar_id order by session_date, o) l from s)
        select calendar_id, session_date, unnest(list_filter([case when o >= c then 'not_open_before_close' end, case when floor(o / 86400000000.0) <> floor(c / 86400000000.0) then 'other_day' end, case when o < l then 'overlaps_last' end], lambda x: x is not null)) reason from w""",
    "late_calendars": f"""with {_SESS}, e as (select calendar_id, max(session_date) d from s group by calendar_id, date_trunc('month', session_date)), k as (select calendar_id, min(epoch_us(available_at)) + 90 * 86400000000 known_us from sessions where calendar_id is not null and session_date is not null group by 1)
        select calendar_id, (d - date '1970-01-01') * 86400000000 formed_us, known_us from e left join k using (calendar_id) where known_us is null or known_us > (d - date '1970-01-01') * 86400000000""",
    "execution_schedule": f"""with {_PLAN}, i as (select calendar_id, min(session_date) first_session, max(session_date) last_session from s where session_date between date '2021-01-01' and date '2022-12-30' group by 1)
        select calendar_id, formation_date, trade_date, first_session, last_session, case when trade_date is null or trade_date > last_session then 'skipped' else 'trade' end action, min(formation_date) over (partition by calendar_id) = first_session sample_begins
        from plan join i using (calendar_id) where formation_date between date '2021-01-01' and date '2022-12-30'""",
    "sleeve_violations": _SLEEVES + """, x as (select formation, security_id, case when formation like '%-08' and bucket = 2 then 1 else bucket end b, case when formation like '%-05' then weight * 1.5 else weight end w from vw union all select formation, security_id, bucket, weight from vw where formation like '%-11' and bucket = 2),
        z as (select formation, b, count(*) n from x group by 1, 2), y as (select formation, list(n order by b) l from z group by 1), s as (select formation, sum(w) filter (w > 0) lo, sum(w) filter (w < 0) sh, count(*) > count(distinct security_id) twice from x group by 1)
        select formation, unnest(list_filter([case when twice then 'name_twice' end, case when not (len(l) = 5 and list_max(l) - list_min(l) <= 1 and l = list_reverse_sort(l)) then 'bucket_sizes' end, case when abs(lo - 1) > 1e-9 then 'long_total' end, case when abs(sh + 1) > 1e-9 then 'short_total' end], lambda q: q is not null)) reason
        from y join s using (formation)""",
    "portfolio_identities": _SLEEVES + f""" select formation, sha256('{"0" * 64}|' || formation || '|' || string_agg(security_id || '=' || printf('%.12f', weight), ',' order by security_id || '=' || printf('%.12f', weight))) portfolio_id from eq group by 1""",
    "component_checks": """select 'environment' what, count(distinct p_brand[1:7]) n from part having n > 1 union all select 'binding:' || p_type, count(distinct p_partkey % 2) n from part group by p_type having n > 1""",
    "solvency_path": """with p as (select o_custkey series, o_orderkey "at", case when o_orderkey % 100 <> 3 then c_acctbal * 200 - sum(o_totalprice) over (partition by o_custkey order by o_orderkey) end nav, max(o_orderkey) over (partition by o_custkey) l from orders join customer on o_custkey = c_custkey)
        select series, "at", 'unknown_nav' reason from p where nav is null union all select series, "at", 'nonpositive_nav' from p where nav <= 0 and "at" < l""",
    "whole_share_rebalance": _ROOTS + """, x as (select batch, round(w, 6) w, cast(security_id[2:3] as int) * 12000 + 75000 p, floor(o / (cast(security_id[2:3] as int) * 12000 + 75000)) h, round(root, 2) v from book join roots using (batch)),
        y as (select *, trunc(w * v / p) s from x), z as (select batch, sum(abs((s - h) * p)) t, sum(case when s > 0 then s * p else 0 end) lo, -sum(case when s < 0 then s * p else 0 end) sh from y group by 1)
        select batch, round(1000000 - t * 0.001, 2) nav, round(t, 2) turnover, round(t * 0.001, 2) fees, round(lo, 2) long, round(sh, 2) short, case when 1000000 - t * 0.001 <= 0 or greatest(lo, sh) > 1000000 - t * 0.001 then 'refused_exposure' when lo = 0 or sh = 0 then 'refused_sleeve' else 'sized' end status from z""",
    "rebalance_trades": _ROOTS + """ select batch, security_id, round(w * root, 2) target, round(w * root - o, 2) trade from book join roots using (batch) union all select batch, 'GONE', 0.0, -1234.5 from roots""",
    "formula_fifty_digits": f"with {_LINES} select *, " + _TRIM.format("cast((q * 3 - cast(n as decimal(18, 6)) / 8.0) * 2 + (p - n) - 0.125 as decimal(30, 6))") + " as value from lines",
    "formula_refusals": f"with {_LINES} select case when p % 60 > 50 then 'magnitude' when q = 13 then 'missing' when q = 10 then 'zero_denominator' end reason, count(*) n from lines group by 1",
    "formula_rationals": f"with {_LINES}, x as (select *, q - n * p nu from lines) select k, n, q, p, case when p <> 0 then " + _RATIO.format("nu", "p") + " end as value from x",
    "formula_equivalence": "select * from (values ('same', true), ('other', false), ('zero', true), ('broken', false), ('sign', true)) t(case_id, equivalent)",
    "terminating_quotients": f"with {_LINES} select *, case when (n // gcd(q, n)) in (1, 2, 4, 5) then " + _TRIM.format("cast(cast(q as decimal(18, 6)) / n as decimal(30, 6))") + " end as value from lines",
    "exact_ordinals": """with q as (select distinct phase f, source_id s, price_usd t, try_cast(trim(price_usd, chr(32) || chr(9) || chr(10) || chr(13)) as decimal(38, 12)) x from quotes where phase is not null), r as (select *, dense_rank() over (partition by f order by x) - 1 o from q where x is not null)
        select f formation, count(*) n, count(distinct o) "distinct", arg_min(t, (o, length(t), t)) least, max(o) "last" from r group by 1""",
    "wide_decimals": "select p_partkey, p_partkey % 29 + 1 <= 28 and cast(repeat('9', cast(p_partkey % 31 + 1 as int)) || repeat('1', cast(p_partkey % 29 + 1 as int)) as double) < 79228162514264337593543950336 and not (p_partkey % 31 + p_partkey % 29 + 2 = 29) fits from part",
    "entry_values": "with x as (select p_partkey, p_partkey * 10000 nu, 10000 + 2 * (p_partkey % 9) de from part) select p_partkey, " + _RATIO.format("nu", "de") + " as value from x",
    "judgment_coverage": """with d as (select distinct case when c_mktsegment = 'MACHINERY' then 'NEW' else c_mktsegment end || ':' || (c_custkey % 4) d from customer), j as (select c_nationkey q, c_mktsegment || ':' || (c_custkey % 4) d from customer where c_acctbal > 3000),
        x as (select q, count(distinct d.d) h, count(distinct j.d) filter (d.d is null) f, count(*) - count(distinct j.d) r from j left join d on j.d = d.d group by 1)
        select c query_id, (select count(*) from d) - coalesce(h, 0) n_missing, coalesce(f, 0) n_foreign, coalesce(r, 0) n_repeated from (select distinct c_nationkey c from customer) left join x on q = c where h is null or h < (select count(*) from d) or f > 0 or r > 0""",
    "source_selection": _HITS + """, p as (select distinct paper_id doc_id from corpus where text is not null and length(text) > 1200), s as (select query_id, doc_id, row_number() over (partition by query_id order by "rank") k from hits join p using (doc_id))
        select query_id, cast(k as int) "position", doc_id, 'packet-' || doc_id packet_id from s where k <= 3""",
    "direction_grading": """with p as (select paper_id, min(text) t from corpus where text is not null and title is not null group by 1), n as (select *, length(t) % 5 m, trim(regexp_replace(t, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') b from p), a as (select *, string_split(b, ' ')[1:3] an, b[1:60] q from n),
        g as (select paper_id, case when paper_id like '%3' then false when m = 4 then true else m <> 1 end c, case when paper_id like '%3' then false when m = 4 then true else m <> 2 and list_bool_and(list_transform(an, lambda x: contains(q, trim(x, ' ')))) end s from a)
        select paper_id case_id, c correct, coalesce(s, true) supported, c and coalesce(s, true) passed from g""",
    "batch_grading": """with x as (select o_orderkey k, case when o_orderkey % 5 = 2 then 'missing' when o_orderkey % 7 = 1 then 'invalid' else 'verified' end e, o_orderstatus = 'F' and o_totalprice > 100000 p from orders) select e evidence, e = 'verified' and p passed, count(*) n, cast(sum(k) as bigint) ids from x group by 1, 2""",
    "candidate_statuses": """with b as (select distinct l_partkey s, l_suppkey % 50 p from lineitem where l_returnflag = 'R' and l_quantity > 40 union select p_partkey, p_partkey % 50 from part where p_partkey % 3 = 0), o as (select l_partkey s, bool_and(l_linestatus = 'O') r from lineitem where l_discount > 0.05 group by 1)
        select p_partkey * 2 "position", p_partkey source_id, p_partkey % 50 packet, case when b.s is null then 'unbound' when r is null then 'source_unavailable' when not r then 'needs_review' else 'compiled' end status from part left join b on b.s = p_partkey and b.p = p_partkey % 50 left join o on o.s = p_partkey""",
    "synthesis_weights": """with x as (select o_custkey c, row_number() over (partition by o_custkey order by o_orderkey) i, count(*) over (partition by o_custkey) n from orders), y as (select c, max(n) n, c % 13 = 5 bad, c % 11 = 3 and max(n) > 1 tw, c % 7 = 1 more from x group by c)
        select c synthesis_id, unnest(list_filter([case when bad then 'not_positive' end, case when tw then 'source_twice' end, case when more and not bad then 'not_one' end], lambda z: z is not null)) reason from y""",
    "synthesis_grades": """select o_orderkey, o_orderstatus = 'F' and o_totalprice > 50000 and o_orderkey % 9 <> 4 and o_orderpriority <> '5-LOW' passed,
        array_to_string(list_filter([case when o_orderstatus <> 'F' then 'completed' end, case when o_totalprice <= 50000 then 'weights' end, case when o_orderkey % 9 = 4 or o_orderpriority = '5-LOW' then 'citations' end], lambda x: x is not null), ',') failed from orders""",
    "metadata_search": "select paper_id doc_id, bool_or(lower('10.1/' || paper_id) = '10.1/paper-00-000005') \"exact\" from corpus where lower('10.1/' || paper_id) = '10.1/paper-00-000005' or list_contains(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), 'momentum') group by 1 order by 2 desc, 1 limit 50",
    "strict_json_reasons": """with q as (select distinct delivery_id i, payload p from quote_events) select case when i % 10 = 1 and p is not null then 'repeated member' when i % 10 = 2 and p is not null then 'not finite' when i % 10 = 3 and p is not null then 'syntax' when i % 10 = 4 then 'depth' when p is null then 'missing' end json_reason, count(*) n, min(i) first_id from q group by 1""",
    "operation_trajectories": """with t as (select distinct l_orderkey k, concat_ws('-', l_linenumber, lpad(l_partkey::varchar, 9, '0'), lpad(l_suppkey::varchar, 9, '0'), cast(l_quantity as int)) a, case when l_returnflag <> 'A' then l_returnflag end o from lineitem), g as (select k, count(*) n, last(o order by a, o nulls first) l from t group by 1)
        select o_orderpriority kind, case when n is null then 'missing' else coalesce(l, 'pending') end status, count(*) n, cast(sum(coalesce(g.n, 0)) as bigint) attempts from orders left join g on k = o_orderkey group by 1, 2""",
    "orders_containing": "select distinct l_orderkey root from lineitem where l_partkey = 5 order by 1 limit 100",
    "closure_checks": """with n as (select distinct l_partkey k from lineitem where l_suppkey % 7 = 2), r as (select l_partkey k, count(distinct case when l_partkey % 10 = 0 and l_linenumber > 4 then 1 else 2 end) c, min(case when l_partkey % 10 = 0 and l_linenumber > 4 then 1 else 2 end) t from lineitem group by 1), s as (select p_partkey k, case when p_partkey % 9 = 4 then 3 else 2 end z from part where p_size > 5)
        select k node, unnest(list_filter([case when c > 1 then 'metadata_conflict' end, case when z is null then 'missing' end, case when c = 1 and z <> t then 'mismatch' end], lambda x: x is not null)) reason from n join r using (k) left join s using (k)""",
    "owner_lookup": """with r as (select distinct o_orderstatus name, 'u' || lpad(o_custkey::varchar, 7, '0') owner, o_orderpriority = '1-URGENT' shared from orders), a as (select * from r where owner like '%3' and name = 'F' and (owner = 'u0000013' or shared) order by owner = 'u0000013' desc, owner, shared limit 1),
        b as (select * from r where owner like '%4' and shared and name = 'P' order by owner limit 1) select * from a union all select * from b""",
    "recovery_order": "select doc_id run_id, available_at last_recovery_at from documents where content_kind = 'research_note' order by available_at nulls first, n_chars nulls first, doc_id limit 40",
    "event_history": """with e as (select user_id u, row_number() over (partition by user_id order by ts, event_id) v, event_type s, event_id i from events) select 'r' || u run_id, string_agg(s, ',' order by v) states, count(*) = max(v) contiguous from e where i % 97 <> 5 group by u""",
    "order_page": "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 100 offset 300",
    "scheduler_outcomes": """select o_orderpriority, case when o_totalprice > 400000 then 'budget_stopped' when o_orderstatus = 'P' then 'skipped' when o_orderkey % 6 = 1 or o_totalprice <= 50000 then 'failed' else 'completed' end status, count(*) n from orders group by 1, 2""",
    "research_reports": """select case when o_orderkey % 10 = 3 then 'unavailable' when o_orderstatus = 'P' then 'failed' when o_orderkey % 4 <> 1 and o_orderpriority = '5-LOW' then 'contested' when o_orderkey % 3 = 2 or o_orderkey % 5 = 0 then 'unvalidated' else 'supported' end verdict, count(*) n, cast(sum(o_orderkey) as bigint) ids from orders group by 1""",
    "index_upsert": "select p_partkey, p_brand, case when p_partkey % 3 = 0 then p_size + 100 else p_size end p_size from part where p_partkey % 4 <> 0 or p_partkey % 3 = 0",
    "content_identities": """select p_partkey, sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || '}') content_id from part""",
    "version_publishing": """with p as (select p_brand d, p_type v, case when p_partkey % 2 = 0 then 'x' else 'y' end b, p_size z from part), o as (select d, v, min(b) ob from p where z < 10 group by 1, 2), n as (select d, v, min(b) nb, count(distinct b) k from p where z between 8 and 14 group by 1, 2), j as (select n.*, ob from n left join o using (d, v))
        select d dataset_id, v version_sha256, case when ob is null and k = 1 then nb end body, case when k > 1 or ob <> nb then 'conflict' else 'append' end outcome from j where ob is null or k > 1 or ob <> nb""",
    "graph_export": """select 'document' kind, count(distinct l_orderkey) n from lineitem union all select 'part', count(distinct l_partkey) from lineitem union all select 'edge', count(*) from (select distinct l_orderkey, l_partkey, l_linenumber from lineitem)""",
    "graph_readback": "select p_partkey, p_brand, case when p_partkey % 50 = 9 then 'not_found' else 'not_sent' end side from part where (p_partkey % 50 = 9) <> (p_partkey % 40 = 7)",
    "metric_export": "select cast(s_suppkey as varchar) run, 's_acctbal' metric, round(s_acctbal, 6) \"value\" from supplier union all select cast(s_suppkey as varchar), 'ratio', round(s_acctbal / (s_suppkey % 5), 6) from supplier where s_suppkey % 5 <> 0",
    "gauge_export": "select 'documents_count' name, coalesce(lang, 'unknown') label, cast(count(*) as double) \"value\" from documents group by 2 union all select 'documents_total', '', cast(count(*) as double) from documents",
    "trace_export": """with o as (select user_id t, event_id o, event_type k, ts a, case when event_id % 50 <> 3 then ts + interval 1 minute end b from events) select t trace_id, 'root:' || t run_id, null parent_id, 'root' kind, min(a) started_at, case when count(*) = count(b) then max(b) end ended_at from o group by t
        union all select t, cast(o as varchar), 'root:' || t, k, a, b from o""",
    "span_export": """select '{"context":{"trace_id":' || user_id || ',"span_id":' || event_id || '},"name":"' || event_type || '","start_time":1,"end_time":2}' "value" from events""",
    "job_queue": """with j as (select arg_min(o_orderkey, (o_orderdate, o_orderkey)) k from orders group by o_orderkey // 3) select o_custkey group_id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) job_id from orders where o_orderkey in (select k from j) and o_orderstatus <> 'F' group by 1""",
    "cache_freshness": "select doc_id, available_at retrieved_at from documents where available_at between timestamp '2022-01-15 12:00:00' - interval 60 day and timestamp '2022-01-15 12:00:00'",
    "discovery_replay": """with e as (select user_id u, event_id i, '10.1/' || case when event_id % 2 = 0 then upper(event_type) else event_type end d, row_number() over (partition by user_id order by event_id) r from events) select u answer_id, cast(min(r) as int) "rank", arg_min(d, r) doi, cast(arg_min(i, r) as varchar) title from e group by u, lower(d)""",
    "dataset_admission": """with o as (select cast(p_partkey as varchar) o from part) select o "object", case when o like '%7' then 'missing' when o like '%9' then 'undeclared' when o like '%3' then 'changed' when o like '%5' then 'rows' else 'admitted' end status from o""",
    "stream_admission": "select cast(delivery_id as varchar) like '%0' and cast(delivery_id as varchar) not like '%50' and octet_length(encode(payload)) <= 16384 admitted, count(*) n from (select distinct delivery_id, payload from quote_events where payload is not null) group by 1",
    "production_order": "select distinct source_id, security_id, observed_at from quotes where source_id is not null and observed_at is not null and security_id is not null order by observed_at, security_id, source_id limit 500",
}

QUERIES = {
    q.__name__: q
    for q in (
        decision_time_violations, decision_order_violations, economic_cutoffs, line_content_conflicts, membership_conflicts_all, signal_usability, impossible_values, phase_marks, loan_cover, required_coverage, session_checks,
        late_calendars, execution_schedule, sleeve_violations, portfolio_identities, component_checks, solvency_path, whole_share_rebalance, rebalance_trades, formula_fifty_digits, formula_refusals, formula_rationals, formula_equivalence,
        terminating_quotients, exact_ordinals, wide_decimals, entry_values, judgment_coverage, source_selection, direction_grading, batch_grading, candidate_statuses, synthesis_weights, synthesis_grades, metadata_search, strict_json_reasons,
        operation_trajectories, orders_containing, closure_checks, owner_lookup, recovery_order, event_history, order_page, scheduler_outcomes, research_reports, index_upsert, content_identities, version_publishing, graph_export, graph_readback,
        metric_export, gauge_export, trace_export, span_export, job_queue, cache_freshness, discovery_replay, dataset_admission, stream_admission, production_order,
    )
}
