"""Queries of ledgers, performance, statistics, retrieval, lineage, saved state and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ledger, lineage, retrieval, stats
from tidemark.operators.deliveries import LEAST_SHARDS, SeenLedger
from tidemark.plans.study import _NAV_SQL, _RETURNS_SQL, _capped, cumulative_nav, rounded
from tidemark.plans.views import PANEL_SQL, segment_panel
from tidemark.session import shared_path
from tidemark.streaming import events as stream
from tidemark.tables import load, micros

FEE_BPS = 4.0


def price_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Order keys and line numbers that come with several prices."""
    return ledger.conflicts_of(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_extendedprice"])


def inventory_conflicts(spark: SparkSession, d: str) -> DataFrame:
    fields = ["symbol", "exchange", "effective_from", "effective_to", "available_at", "source_id"]
    return ledger.conflicts_of(load(spark, d, "security_history"), ["security_id", "effective_from"], [f for f in fields if f != "effective_from"]).filter("security_id is not null")


def _fills(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as fills of their supplier's account: returned ones are sales."""
    li = load(spark, d, "lineitem")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    cents = F.round(ledger.fill_cash(signed, F.col("l_extendedprice") / F.col("l_quantity"), FEE_BPS) * 10_000).cast("bigint")
    return li.select(F.col("l_suppkey").alias("account"), F.col("l_partkey").alias("security_id"), "l_orderkey", "l_linenumber", micros(li, "l_shipdate").alias("t"), signed.cast("bigint").alias("shares"), cents.alias("cash"))


ORDER = ["l_orderkey", "l_linenumber", "security_id", "shares", "cash"]


def ledger_running_cash(spark: SparkSession, d: str) -> DataFrame:
    out = ledger.running_totals(_fills(spark, d), "account", F.col("t"), ORDER, {"total_cash": "cash"})
    return out.select("account", "t", "l_orderkey", "l_linenumber", "security_id", "cash", F.col("total_cash").cast("bigint"))


def ledger_positions(spark: SparkSession, d: str) -> DataFrame:
    return _fills(spark, d).groupBy("account", "security_id").agg(F.sum("shares").alias("shares"), F.sum("cash").alias("cash"), F.count("*").alias("n_fills"))


def event_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Customers' first orders of a day take effect, orders are paid, large ones are filled."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("at"), F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("amount"), "o_orderstatus")
    parts = [o.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("F", "O", "P")]
    return ledger.event_timeline(*parts).withColumn("seq", F.col("seq").cast("int"))


def dividend_claims(spark: SparkSession, d: str) -> DataFrame:
    fills = _fills(spark, d).withColumn("t", F.floor(F.col("t") / 86_400_000_000).cast("bigint"))
    held = fills.groupBy("account", "security_id", "t").agg(F.sum("shares").alias("shares"))
    held = ledger.running_totals(held.withColumn("pair", F.concat_ws(":", "account", "security_id")), "pair", F.col("t"), ["shares"], {"total": "shares"})
    positions = held.select("account", "security_id", "t", F.col("total").alias("shares"))
    part = load(spark, d, "part")
    actions = part.select(F.col("p_partkey").alias("security_id"), F.col("p_partkey").alias("action_id"), F.lit(10_000).cast("bigint").alias("t"), F.lit(10_030).cast("bigint").alias("pay_at"), F.col("p_retailprice").alias("per_share"))
    return rounded(ledger.claims(positions, actions), "amount", places=2)


def nav_valuation(spark: SparkSession, d: str) -> DataFrame:
    positions = _fills(spark, d).groupBy("account", "security_id").agg(F.sum("shares").alias("shares"))
    cash = load(spark, d, "supplier").select(F.col("s_suppkey").alias("account"), F.col("s_acctbal").alias("cash"))
    prices = load(spark, d, "part").filter("p_size > 2").select(F.col("p_partkey").alias("security_id"), F.col("p_retailprice").alias("price"))
    return rounded(ledger.valuation(positions.join(cash, "account"), prices), "nav", places=2)


def ledger_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Cash by the running ledger against cash by plain sums without the last hundredth of suppliers."""
    fills = _fills(spark, d)
    last = ledger.running_totals(fills, "account", F.col("t"), ORDER, {"total": "cash"}).groupBy("account").agg(F.max_by("total", F.struct("t", *ORDER)).cast("bigint").alias("cash"))
    plain = fills.filter("account % 100 <> 7").groupBy("account").agg(F.sum("cash").alias("cash"))
    return ledger.reconcile(last, plain, ["account"], "cash")


def _nav(spark: SparkSession, d: str) -> DataFrame:
    return cumulative_nav(spark, d).select(F.col("symbol").alias("series"), F.col("month").alias("at"), "nav")


def nav_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger.nav_returns(_nav(spark, d)), "ret", places=5)


def drawdown_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger.drawdowns(_nav(spark, d)), "drawdown", places=5)


def performance_summary(spark: SparkSession, d: str) -> DataFrame:
    rets = _capped(spark, d).select(F.col("symbol").alias("series"), F.col("r").alias("ret"), F.lit(0.0001).alias("risk_free"))
    return rounded(ledger.performance_summary(rets, 12), "mean", "mean_excess", "variance", "sharpe")


def turnover_metric(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    batches = o.select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("batch"), F.col("o_totalprice").alias("traded"), F.lit(999_983.0).alias("nav_before"))
    return rounded(ledger.turnover(batches), "turnover")


def _series(spark: SparkSession, d: str) -> DataFrame:
    w = ledger.Window.partitionBy("symbol").orderBy("month")
    return _capped(spark, d).select(F.col("symbol").alias("series"), (F.row_number().over(w) - 1).alias("idx"), F.col("r").alias("value"))


def hac_tstat(spark: SparkSession, d: str) -> DataFrame:
    out = stats.hac_mean(_series(spark, d).withColumn("value", F.col("value") * 100), 4, True)
    return rounded(out, "mean", "variance_mean", "standard_error", "t_statistic", places=5)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """A segment's days as labels of ten days each, some known five days late."""
    panel = segment_panel(spark, d)
    w = ledger.Window.partitionBy("symbol").orderBy("date")
    day = F.unix_date("date")
    late = F.when(F.pmod(day, F.lit(3)) == 0, 5).otherwise(0)
    return panel.select(F.col("symbol").alias("series"), (F.row_number().over(w) - 1).cast("bigint").alias("idx"), day.alias("start"), (day + 10).alias("end"), (day + 10 + late).alias("available"), "price")


def walk_forward_folds(spark: SparkSession, d: str) -> DataFrame:
    folds = stats.walk_forward(_labels(spark, d), 200, 60)
    return folds.groupBy("series", "fold", "role").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def purged_embargo_folds(spark: SparkSession, d: str) -> DataFrame:
    return stats.purged_fold(_labels(spark, d), 120, 180, 7)


def fold_test_means(spark: SparkSession, d: str) -> DataFrame:
    labels = _labels(spark, d)
    test = stats.walk_forward(labels, 200, 60).filter("role = 'test'").join(labels.select("series", "idx", "price"), ["series", "idx"])
    return rounded(test.groupBy("series", "fold").agg(F.count("*").alias("n"), F.avg("price").alias("mean_price")), "mean_price", places=2)


def pass_rate_gate(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    cases = lambda limit: o.select(F.col("o_orderkey").alias("case_id"), (F.col("o_totalprice") < limit).alias("passed"))
    return stats.gate(cases(400_000), cases(370_000))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "corpus").filter("text is not null").groupBy(F.col("paper_id").alias("doc_id")).agg(F.min(F.concat_ws("\n", "title", "text")).alias("text"))


def bm25_index_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.term_stats(_notes(spark, d)), "idf")


QUESTIONS = [("q1", "momentum spread shrinks after costs"), ("q2", "restated revenue amendment"), ("q3", "short borrow fee basis points"), ("q4", "zzzunknownterm"), ("q5", "The closing quote arrived late")]


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The five questions, and the titles of each paper whose number is divisible by 100."""
    number = F.expr("try_cast(regexp_extract(paper_id, '([0-9]+)$', 1) as bigint)")
    titles = load(spark, d, "corpus").filter((number % 100 == 0) & F.col("title").isNotNull()).groupBy(F.col("paper_id").alias("query_id")).agg(F.array_join(F.array_sort(F.collect_set("title")), "\n").alias("query"))
    return spark.createDataFrame(QUESTIONS, "query_id string, query string").unionByName(titles)


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    return retrieval.search(_notes(spark, d), _asked(spark, d), k)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_hits(spark, d, 10), "score", places=5)


def retrieval_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    """A text is relevant to a question if it holds the question's second word, or its only one."""
    words = retrieval.terms(F.col("query"))
    asked = _asked(spark, d).select("query_id", F.coalesce(F.get(words, F.lit(1)), F.get(words, F.lit(0))).alias("word"))
    judged = _notes(spark, d).select("doc_id", F.explode(F.array_distinct(retrieval.terms(F.col("text")))).alias("word")).join(asked, "word").select("query_id", "doc_id", F.lit(1).alias("relevant"))
    unanswerable = asked.select("query_id", F.lit("none").alias("doc_id"), F.lit(0).alias("relevant"))
    return rounded(retrieval.retrieval_metrics(_hits(spark, d, 10), judged.unionByName(unanswerable), 10), "recall", "mrr", "false_positive", "abstention")


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", retrieval.normalize(F.col("text")).alias("text"))


def dedupe_first_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select(F.col("lang").alias("key"), F.col("doc_id").alias("rank"))
    return retrieval.dedupe_first_rank(rows, F.col("key"), "rank")


def field_match_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Each order's fields against those of the order with the key before."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"))
    given = o.withColumn("case_id", F.col("case_id") + 1).filter("case_id % 10 <> 3")
    return rounded(retrieval.field_accuracy(o, given, ["o_orderstatus", "o_orderpriority", "year"]), "accuracy")


def memory_search(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").filter("available_at is not null").select("doc_id", "text", "available_at")
    return retrieval.find_notes(rows, "text", "Restated", "available_at", 50).select("doc_id", "available_at")


def batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders: none, only unfinished, or finished."""
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    by = c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey", "c_mktsegment").agg(F.count("o_orderkey").alias("n"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("done"))
    status = F.when(F.col("n") == 0, "missing").when(F.col("done") == 0, "invalid").otherwise("passed")
    return by.groupBy(F.col("c_mktsegment").alias("segment"), status.alias("status")).agg(F.count("*").alias("n_cases"))


def candidate_status(spark: SparkSession, d: str) -> DataFrame:
    """Each part as a source: bound if some supplier's line of it was returned, observed if any line exists."""
    p, li = load(spark, d, "part").select("p_partkey"), load(spark, d, "lineitem")
    bound = li.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("bound", F.lit(True))
    seen = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    out = p.join(bound, "p_partkey", "left").join(seen, "p_partkey", "left")
    status = F.when(F.col("n").isNull(), "source_unavailable").when(F.col("bound").isNull(), "unbound").when(F.col("n") < 20, "needs_review").otherwise("compiled")
    return out.select("p_partkey", status.alias("status"))


def graph_closure(spark: SparkSession, d: str) -> DataFrame:
    """Customers of nation 3, their orders, those orders' parts, and those parts' suppliers."""
    c, o, li = load(spark, d, "customer"), load(spark, d, "orders"), load(spark, d, "lineitem")
    node = lambda kind, col: F.concat(F.lit(kind), F.col(col).cast("string"))
    edges = c.select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst"))
    edges = edges.unionByName(o.select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst")))
    edges = edges.unionByName(li.select(node("o", "l_orderkey").alias("src"), node("p", "l_partkey").alias("dst")).distinct())
    edges = edges.unionByName(li.select(node("p", "l_partkey").alias("src"), node("s", "l_suppkey").alias("dst")).distinct())
    return lineage.closure(edges, spark.createDataFrame([("n3",)], "node string"))


def reverse_lineage(spark: SparkSession, d: str) -> DataFrame:
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    return li.filter("l_partkey = 5").join(o, li["l_orderkey"] == o["o_orderkey"]).select("o_orderkey", "o_custkey").distinct().orderBy("o_orderkey").limit(100)


def operation_rollup(spark: SparkSession, d: str) -> DataFrame:
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("attempts"))
    both = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left")
    return both.groupBy("o_orderpriority").agg(F.count("*").alias("operations"), F.sum(F.coalesce("attempts", F.lit(0))).cast("bigint").alias("attempts"), F.count(F.when(F.col("attempts").isNull(), 1)).alias("pending"))


def leakage_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").filter("text is not null")
    part = docs.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("prompt"), F.col("doc_id").cast("string").alias("run"))
    return lineage.overlap(part.filter("doc_id % 5 <> 0"), part.filter("doc_id % 5 = 0"), ["prompt", "run"])


def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return lineage.preference_pairs(e.select(F.concat_ws("@", "user_id", F.to_date("ts").cast("string")).alias("prompt"), F.col("event_id").cast("string").alias("answer"), F.col("value").alias("score")))


def idempotent_insert(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "quotes").filter("source_id is not null").select("source_id", F.coalesce("price_usd", F.lit("")).alias("body"), "phase")
    changed = F.when(F.substring("source_id", -1, 1) == "7", F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    return lineage.idempotent_insert(q.filter("phase = 'open' or source_id like '%1'"), q.withColumn("body", changed), "source_id", "body")


def recovery_queue(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.filter("lang = 'en'").orderBy(F.col("available_at").asc_nulls_first(), "doc_id").limit(50).select("doc_id", "available_at")


def budget_running_commit(spark: SparkSession, d: str) -> DataFrame:
    """Orders as reservations, in cents; finished ones were charged nine tenths."""
    o = load(spark, d, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    actual = F.when(F.col("o_orderstatus") == "F", F.floor(cents * 9 / 10).cast("bigint"))
    ev = o.select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("at"), cents.alias("reserved"), actual.alias("actual"))
    return lineage.budget_commitments(ev, 200_000_000).withColumn("committed", F.col("committed").cast("bigint"))


def outcome_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    status = F.when(F.col("o_totalprice") > 450_000, "budget_stopped").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    return o.groupBy(F.year("o_orderdate").alias("year"), status.alias("status")).agg(F.count("*").alias("n"))


def page_slice(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(200).limit(100).select("o_orderkey", "o_totalprice")


def event_identity(spark: SparkSession, d: str) -> DataFrame:
    return stream.identify(load(spark, d, "quotes").filter("source_id is not null and security_id is not null"), "archive").select("source_id", "event_id", "route").distinct()


def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries as a stream, from its first offset to its end: what the ledger kept, as read back from the sink."""
    root = shared_path(spark, "stream")
    came = spark.readStream.schema(load(spark, d, "quote_events").schema).parquet(f"{d}/quote_events.parque[t]")  # as a pattern, so that a file and a folder will do
    stream.dedupe_stream(came, SeenLedger(spark, f"{root}/seen", LEAST_SHARDS), f"{root}/kept", f"{root}/progress", conflicts="keep").awaitTermination()
    return spark.read.parquet(f"{root}/kept").select(F.col("key").alias("event_id"), "delivery_id")


def stream_first_payloads(spark: SparkSession, d: str) -> DataFrame:
    return stream.first_payloads(load(spark, d, "quote_events")).select("event_id", "delivery_id")


def stream_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return stream.payload_conflicts(load(spark, d, "quote_events"))


_FILLS = """fills as (select l_suppkey account, l_partkey security_id, l_orderkey, l_linenumber, epoch_us(l_shipdate) t, cast(case when l_returnflag = 'R' then -l_quantity else l_quantity end as bigint) shares,
    cast(round((-(case when l_returnflag = 'R' then -l_quantity else l_quantity end) * (l_extendedprice / l_quantity) - abs((case when l_returnflag = 'R' then -l_quantity else l_quantity end) * (l_extendedprice / l_quantity)) * (4.0 / 1e4)) * 10000) as bigint) cash from lineitem)"""
_LABELS = f"{PANEL_SQL}, labels as (select symbol series, row_number() over (partition by symbol order by date) - 1 idx, date - date '1970-01-01' st, price from panel), lab as (select series, idx, st, st + 10 en, st + 10 + case when st % 3 = 0 then 5 else 0 end av, price from labels)"
_FOLDS = f"""with {_LABELS}, n as (select series, max(idx) + 1 n from lab group by 1),
    f as (select series, unnest(range(0, cast((n - 201) // 60 + 1 as bigint))) fold from n where n > 200),
    fs as (select f.series, fold, 200 + fold * 60 fi, st ts from f join lab on lab.series = f.series and lab.idx = 200 + fold * 60),
    folds as (select lab.series, fold, idx, price, case when idx >= fi then 'test' when av < ts then 'train' else 'purged' end "role" from lab join fs on lab.series = fs.series where idx < fi + 60)"""
_WORDS = "'[\\p{L}\\p{N}]+'"
_NOTES = f"""notes as (select paper_id doc_id, min(coalesce(title || chr(10), '') || text) raw from corpus where text is not null group by 1), tok as (select doc_id, regexp_extract_all(lower(raw), {_WORDS}) ts from notes)"""
_ASKED = f"""asked as (select q[1] query_id, q[2] query from (select unnest({[list(q) for q in QUESTIONS]}) q) union all
      select paper_id, string_agg(distinct title, chr(10) order by title) from corpus where try_cast(regexp_extract(paper_id, '([0-9]+)$', 1) as bigint) % 100 = 0 and title is not null group by 1)"""
_HITS = f"""with {_NOTES}, {_ASKED}, ask as (select distinct query_id, unnest(regexp_extract_all(lower(query), {_WORDS})) term from asked),
    post as (select doc_id, len(ts) l, unnest(ts) term from tok), tf as (select doc_id, l, term, count(*) tf from post group by all), df as (select term, count(*) df from tf group by 1), tot as (select count(*) n, avg(len(ts)) m from tok),
    sc as (select query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))) score from tf join df using (term) join ask using (term), tot group by 1, 2),
    hits as (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as int) "rank" from sc where score > 0 qualify "rank" <= 10)"""
_PAYLOAD = "ev as (select *, lower(trim(coalesce(nullif(trim(event_id, chr(32) || chr(9)), ''), payload ->> '$.event_id'), chr(32) || chr(9))) k from quote_events)"

SQL = {
    "price_conflicts": "select l_orderkey, l_linenumber, count(distinct l_extendedprice) n_versions, count(*) n_rows from lineitem group by 1, 2 having n_versions > 1",
    "inventory_conflicts": "select security_id, effective_from, count(distinct (symbol, exchange, effective_to, available_at, source_id)) n_versions, count(*) n_rows from security_history where security_id is not null group by 1, 2 having n_versions > 1",
    "ledger_running_cash": f"with {_FILLS} select account, t, l_orderkey, l_linenumber, security_id, cash, cast(sum(cash) over (partition by account order by t, l_orderkey, l_linenumber, security_id, shares, cash rows unbounded preceding) as bigint) total_cash from fills",
    "ledger_positions": f"with {_FILLS} select account, security_id, cast(sum(shares) as bigint) shares, cast(sum(cash) as bigint) cash, count(*) n_fills from fills group by 1, 2",
    "event_timeline": """with l as (select o_custkey account, cast(o_orderdate as date) "at", o_orderkey event_id, o_totalprice amount, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end phase from orders where o_orderstatus in ('F', 'O', 'P'))
        select *, cast(row_number() over (partition by account order by "at", phase, event_id, amount) as int) seq from l""",
    "dividend_claims": f"""with {_FILLS}, held as (select account, security_id, sum(shares) shares from fills where t // 86400000000 <= 10000 group by 1, 2)
        select account, p_partkey action_id, cast(10030 as bigint) pay_at, round(shares * p_retailprice, 2) amount from held join part on p_partkey = security_id where shares <> 0""",
    "nav_valuation": f"""with {_FILLS}, pos as (select account, security_id, sum(shares) shares from fills group by 1, 2)
        select account, round(max(s_acctbal) + sum(coalesce(shares * p_retailprice, 0)), 2) nav, count(*) filter (p_retailprice is null and shares <> 0) unpriced
        from pos join supplier on s_suppkey = account left join (select * from part where p_size > 2) on p_partkey = security_id group by 1""",
    "ledger_reconcile": f"with {_FILLS} select account, cast(sum(cash) as bigint) left_value, cast(null as bigint) right_value from fills where account % 100 = 7 group by 1",
    "nav_returns": _NAV_SQL + ", rn as (select symbol series, month \"at\", round(nav, 6) nav from navs) select *, round(nav / lag(nav) over (partition by series order by \"at\") - 1, 5) ret from rn",
    "drawdown_curve": _NAV_SQL + ", rn as (select symbol series, month \"at\", round(nav, 6) nav from navs) select *, round(1 - nav / max(nav) over (partition by series order by \"at\" rows unbounded preceding), 5) drawdown from rn",
    "performance_summary": _RETURNS_SQL + """ select symbol series, count(*) n, round(avg(r), 6) mean, round(avg(r - 0.0001), 6) mean_excess, round(var_samp(r - 0.0001), 6) variance, round(sqrt(12.0) * avg(r - 0.0001) / sqrt(var_samp(r - 0.0001)), 6) sharpe,
        cast(null as varchar) reason from rets group by 1""",
    "turnover_metric": "select o_custkey account, round(sum(t / 999983.0), 6) turnover, count(*) n_batches from (select o_custkey, o_orderkey, max(o_totalprice) t from orders group by 1, 2) group by 1",
    "hac_tstat": _RETURNS_SQL + """, s as (select symbol series, r * 100 v, row_number() over (partition by symbol order by month) i, count(*) over (partition by symbol) n, avg(r * 100) over (partition by symbol) m from rets),
        u as (select *, v - m u from s where n > 4), a as (select a.series, a.n, a.m, sum(a.u * a.u) s0 from u a group by 1, 2, 3),
        l as (select a.series, sum(2 * (1 - (a.i - b.i) / 5.0) * a.u * b.u) s1 from u a join u b on a.series = b.series and a.i - b.i between 1 and 4 group by 1),
        f as (select series, n, m, greatest(0, (s0 + s1) / (n * n) * (n / (n - 1.0))) vm from a join l using (series))
        select series, n, round(m, 5) mean, round(vm, 5) variance_mean, round(sqrt(vm), 5) standard_error, round(case when vm > 0 then m / sqrt(vm) end, 5) t_statistic from f""",
    "walk_forward_folds": _FOLDS + " select series, cast(fold as int) fold, \"role\", count(*) n, min(idx) first_idx, max(idx) last_idx from folds group by 1, 2, 3",
    "purged_embargo_folds": f"""with {_LABELS}, b as (select series, min(st) a, max(en) z from lab where idx between 120 and 180 group by 1)
        select series, idx, case when idx between 120 and 180 then 'test' when st <= z and en >= a then 'purged' when st > z and st <= z + 7 then 'embargoed' else 'train' end "role" from lab join b using (series)""",
    "fold_test_means": _FOLDS + " select series, cast(fold as int) fold, count(*) n, round(avg(price), 2) mean_price from folds where \"role\" = 'test' group by 1, 2",
    "pass_rate_gate": """with b as (select o_orderkey k, o_totalprice < 400000 b, o_totalprice < 370000 a from orders) select count(*) cases, count(*) filter (b) passed_before, count(*) filter (a) passed_after, (count(*) filter (b) - count(*) filter (a)) * 20 >= count(*) filter (b) regressed from b""",
    "bm25_index_stats": f"with {_NOTES}, tf as (select doc_id, term, count(*) tf from (select doc_id, unnest(ts) term from tok) group by all), n as (select count(*) n from tok) select term, count(*) df, cast(sum(tf) as bigint) cf, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) idf from tf, n group by 1",
    "bm25_topk": _HITS + " select query_id, \"rank\", doc_id, round(score, 5) score from hits",
    "retrieval_recall_mrr": _HITS + f""", w as (select query_id, coalesce(ws[2], ws[1]) word from (select query_id, regexp_extract_all(lower(query), {_WORDS}) ws from asked)), rel as (select w.query_id, doc_id from w join tok on list_contains(ts, word)),
        per as (select w.query_id, count(rel.doc_id) r from w left join rel on rel.query_id = w.query_id group by 1), got as (select query_id, count(*) f, min("rank") fr from hits join rel using (query_id, doc_id) group by 1),
        anyh as (select query_id, count(*) h from hits group by 1), a as (select * from per left join got using (query_id) left join anyh using (query_id))
        select count(*) filter (r > 0) n_answerable, round(avg(coalesce(f, 0) / r) filter (r > 0), 6) recall, round(avg(coalesce(1.0 / fr, 0)) filter (r > 0), 6) mrr, round(avg(case when h > 0 then 1.0 else 0.0 end) filter (r = 0), 6) false_positive, round(avg(case when h > 0 then 0.0 else 1.0 end) filter (r = 0), 6) abstention from a""",
    "normalize_text": "select doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') text from documents",
    "dedupe_first_rank": "select arg_min(lang, doc_id) \"key\", min(doc_id) \"rank\" from documents where lang is not null group by lower(lang)",
    "field_match_accuracy": """with o as (select o_orderkey k, o_orderstatus s, o_orderpriority p, year(o_orderdate) y from orders), j as (select a.*, b.k bk, b.s bs, b.p bp, b.y bq from o a left join o b on a.k = b.k + 1 and (b.k + 1) % 10 <> 3)
        select * from (select count(*) cases, 'o_orderstatus' field, count(*) filter (bk is not null and s = bs) matches, round(count(*) filter (bk is not null and s = bs) / count(*), 6) accuracy from j
        union all select count(*), 'o_orderpriority', count(*) filter (bk is not null and p = bp), round(count(*) filter (bk is not null and p = bp) / count(*), 6) from j
        union all select count(*), 'year', count(*) filter (bk is not null and y = bq), round(count(*) filter (bk is not null and y = bq) / count(*), 6) from j)""",
    "memory_search": "select doc_id, available_at from documents where available_at is not null and contains(lower(text), 'restated') order by available_at desc, doc_id desc limit 50",
    "batch_outcomes": """with b as (select c_custkey, c_mktsegment, count(o_orderkey) n, count(*) filter (o_orderstatus = 'F') f from customer left join orders on c_custkey = o_custkey group by 1, 2)
        select c_mktsegment segment, case when n = 0 then 'missing' when f = 0 then 'invalid' else 'passed' end status, count(*) n_cases from b group by 1, 2""",
    "candidate_status": """with s as (select l_partkey k, count(*) n, count(*) filter (l_returnflag = 'R') r from lineitem group by 1)
        select p_partkey, case when n is null then 'source_unavailable' when r = 0 then 'unbound' when n < 20 then 'needs_review' else 'compiled' end status from part left join s on k = p_partkey""",
    "graph_closure": """with recursive e as (select 'n' || c_nationkey src, 'c' || c_custkey dst from customer union select 'c' || o_custkey, 'o' || o_orderkey from orders union select 'o' || l_orderkey, 'p' || l_partkey from lineitem union select 'p' || l_partkey, 's' || l_suppkey from lineitem),
        r as (select 'n3' node, 0 depth union select dst, depth + 1 from r join e on src = node) select node, cast(min(depth) as int) depth from r group by 1""",
    "reverse_lineage": "select distinct o_orderkey, o_custkey from lineitem join orders on l_orderkey = o_orderkey where l_partkey = 5 order by 1 limit 100",
    "operation_rollup": "with a as (select l_orderkey, count(*) n from lineitem group by 1) select o_orderpriority, count(*) operations, cast(sum(coalesce(n, 0)) as bigint) attempts, count(*) filter (n is null) pending from orders left join a on o_orderkey = l_orderkey group by 1",
    "leakage_overlap": """with d as (select doc_id, md5(text) prompt from documents where text is not null) select 'prompt' "column", prompt "value" from (select prompt from d where doc_id % 5 <> 0 intersect select prompt from d where doc_id % 5 = 0)""",
    "preference_pairs": """with a as (select user_id || '@' || cast(cast(ts as date) as varchar) prompt, cast(event_id as varchar) answer, "value" score from events)
        select prompt, arg_max(answer, (score, answer)) chosen, arg_min(answer, (score, answer)) rejected from a group by 1 having max(score) > min(score)""",
    "idempotent_insert": """with q as (select source_id, coalesce(price_usd, '') body, phase from quotes where source_id is not null), n as (select source_id, min(case when right(source_id, 1) = '7' then body || '!' else body end) nb from q group by 1),
        o as (select source_id, min(body) ob from q where phase = 'open' or source_id like '%1' group by 1) select n.source_id, case when ob is null then 'inserted' when ob = nb then 'unchanged' else 'conflict' end outcome from n left join o using (source_id)""",
    "recovery_queue": "select doc_id, available_at from documents where lang = 'en' order by available_at nulls first, doc_id limit 50",
    "budget_running_commit": """with e as (select o_custkey account, o_orderkey seq, cast(o_orderdate as date) "at", cast(round(o_totalprice * 100) as bigint) reserved, case when o_orderstatus = 'F' then cast(floor(cast(round(o_totalprice * 100) as bigint) * 9 / 10) as bigint) end actual from orders)
        select account, seq, "at", reserved, actual, cast(sum(coalesce(actual, reserved)) over w as bigint) committed, sum(coalesce(actual, reserved)) over w > 200000000 over_cap,
        coalesce("at" < max("at") over (partition by account order by seq rows between unbounded preceding and 1 preceding), false) clock_back from e window w as (partition by account order by seq rows unbounded preceding)""",
    "outcome_rollup": """select cast(year(o_orderdate) as int) "year", case when o_totalprice > 450000 then 'budget_stopped' when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'O' then 'skipped' else 'failed' end status, count(*) n from orders group by 1, 2""",
    "page_slice": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100 offset 200",
    "event_identity": "select distinct source_id, sha256('archive:' || source_id) event_id, 'archive:' || security_id route from quotes where source_id is not null and security_id is not null",
    "stream_dedupe": f"with {_PAYLOAD} select k event_id, arg_min(delivery_id, (received_at, delivery_id)) delivery_id from ev where k is not null group by 1",
    "stream_first_payloads": f"with {_PAYLOAD} select k event_id, arg_min(delivery_id, (received_at, delivery_id)) delivery_id from ev where k is not null group by 1",
    "stream_conflicts": f"with {_PAYLOAD} select k event_id, count(distinct payload) n_payloads, count(*) n_deliveries from ev where k is not null group by 1 having n_payloads > 1",
}

QUERIES = {
    q.__name__: q
    for q in (
        price_conflicts, inventory_conflicts, ledger_running_cash, ledger_positions, event_timeline, dividend_claims, nav_valuation, ledger_reconcile, nav_returns, drawdown_curve, performance_summary, turnover_metric, hac_tstat,
        walk_forward_folds, purged_embargo_folds, fold_test_means, pass_rate_gate, bm25_index_stats, bm25_topk, retrieval_recall_mrr, normalize_text, dedupe_first_rank, field_match_accuracy, memory_search, batch_outcomes, candidate_status,
        graph_closure, reverse_lineage, operation_rollup, leakage_overlap, preference_pairs, idempotent_insert, recovery_queue, budget_running_commit, outcome_rollup, page_slice, event_identity, stream_dedupe, stream_first_payloads, stream_conflicts,
    )
}
