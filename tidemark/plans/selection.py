"""Queries of point-in-time selection, calendars, formulas, allocation and funding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import alloc, calendar, formula, funding, pit, study
from tidemark.plans.study import _signal_sql, rounded
from tidemark.plans.views import MONTHLY_SQL, monthly
from tidemark.tables import load, micros

AT = "2021-06-30 12:00:00"
LINES_AT = "1999-06-30 12:00:00"
CUTOFF = "1999-05-31"
CONCEPTS = ["A", "R"]
MONTHS = 6


def _at(text: str = AT):
    return F.lit(text).cast("timestamp_ntz")


def _line_facts(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as facts of their supplier: an instant value of the order's day, known when shipped."""
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("security_id"), F.col("l_returnflag").alias("concept"), F.lit(None).cast("date").alias("period_start"), F.to_date("o_orderdate").alias("period_end"),
        F.col("l_extendedprice").cast("decimal(15,2)").cast("string").alias("value"), F.lit("USD").alias("unit"), F.col("l_shipdate").alias("available_at"), F.concat(F.lit("L"), F.col("l_partkey").cast("string")).alias("source_id"), F.col("l_linenumber").alias("revision"),
    )


def _line_selected(spark: SparkSession, d: str) -> DataFrame:
    return pit.select_facts(_line_facts(spark, d), _at(LINES_AT))


def _cutoff():
    return F.lit(CUTOFF).cast("date")


def _selected(spark: SparkSession, d: str) -> DataFrame:
    return pit.select_facts(load(spark, d, "facts"), _at())


def pit_select_facts(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d)


def pit_fact_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return pit.fact_conflicts(_line_facts(spark, d).withColumn("period_end", F.trunc("period_end", "year")), _at(LINES_AT))


def _membership(spark: SparkSession, d: str) -> DataFrame:
    """events as membership: everything but an error includes the user, and is known an hour later."""
    e = load(spark, d, "events")
    return e.select(F.col("user_id").alias("security_id"), "event_id", (F.col("event_type") != "error").alias("included"), F.col("ts").alias("effective_at"), (F.col("ts") + F.expr("interval 1 hour")).alias("available_at"))


def pit_universe(spark: SparkSession, d: str) -> DataFrame:
    return pit.select_universe(_membership(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("security_id", "event_id")


def pit_membership_conflicts(spark: SparkSession, d: str) -> DataFrame:
    m = _membership(spark, d)
    return pit.membership_conflicts(m.withColumns({c: F.to_date(c) for c in ("effective_at", "available_at")}))


def pit_month_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    return pit.monthly_cells(_line_selected(spark, d), _cutoff()).filter("n > 1").select("security_id", "concept", "unit", "month", "n")


def _values(spark: SparkSession, d: str) -> DataFrame:
    facts = _line_facts(spark, d)
    cells = pit.monthly_cells(_line_selected(spark, d), _cutoff()).groupBy("security_id", "concept", "month").agg(F.max("value").alias("value"))
    return pit.cell_values(pit.requested_cells(facts.filter("security_id is not null"), CONCEPTS, _cutoff(), MONTHS), cells)


def pit_missing_cells(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).filter("value is null").select("security_id", "concept", "month")


def pit_complete_history(spark: SparkSession, d: str) -> DataFrame:
    return pit.complete_histories(_values(spark, d), MONTHS).withColumn("series", F.concat_ws("|", "series"))


def pit_facts_in_universe(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the securities that some formation asks for."""
    asked = load(spark, d, "formations").select("security_id").distinct()
    return _selected(spark, d).join(asked, "security_id", "left_semi").select("security_id", "concept", "period_end", "source_id")


def pit_invalid_facts(spark: SparkSession, d: str) -> DataFrame:
    return pit.invalid_facts(_line_facts(spark, d))


def exact_quote_marks(spark: SparkSession, d: str) -> DataFrame:
    quotes = load(spark, d, "quotes")
    asked = quotes.filter("phase = 'close'").select(F.col("source_id").alias("request_id"), "security_id", F.col("observed_at").alias("at")).distinct()
    return pit.exact_quotes(asked, quotes)


def borrow_interval_join(spark: SparkSession, d: str) -> DataFrame:
    grants, formations = load(spark, d, "borrow_grants"), load(spark, d, "formations")
    known = grants.filter("security_id is not null and valid_from is not null and valid_through is not null and available_at is not null and source_id is not null")
    known = known.groupBy("source_id", "security_id", "available_at", "valid_from", "valid_through").agg(F.max("maximum_short_shares").alias("shares"))
    known = known.select(F.col("security_id").alias("key"), F.greatest(micros(known, "valid_from"), micros(known, "available_at")).alias("from_us"), micros(known, "valid_through").alias("through_us"), F.coalesce(F.expr("try_cast(shares as bigint)"), F.lit(0).cast("bigint")).alias("amount"))
    asked = formations.filter("trade_at is not null and security_id is not null").select(F.col("formation_id").alias("request_id"), F.col("security_id").alias("key"), micros(formations, "trade_at").alias("t")).distinct()
    out = pit.active_intervals(asked, known.filter("from_us <= through_us"))
    status = F.when(F.col("n_active") == 1, "active").when(F.col("n_active") == 0, "missing").otherwise("ambiguous")
    return out.select(F.col("request_id").alias("formation_id"), F.col("key").alias("security_id"), "n_active", status.alias("status"), F.when(F.col("n_active") == 1, F.col("total")).alias("shares"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return calendar.unique_sessions(load(spark, d, "sessions"))


def month_end_sessions(spark: SparkSession, d: str) -> DataFrame:
    return calendar.month_ends(_sessions(spark, d), F.lit("2021-01-15").cast("date"), F.lit("2022-12-20").cast("date"))


def june_rebalances(spark: SparkSession, d: str) -> DataFrame:
    return calendar.month_ends(_sessions(spark, d), only_month=6)


def formation_trade_plan(spark: SparkSession, d: str) -> DataFrame:
    return calendar.formation_plan(_sessions(spark, d), 2)


def _order_days(spark: SparkSession, d: str) -> DataFrame:
    """The days on which a nation ordered urgently as its sessions: unlike the sessions table, with gaps."""
    o, c = load(spark, d, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'"), load(spark, d, "customer")
    return calendar.unique_sessions(o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("calendar_id"), F.to_date("o_orderdate").alias("session_date")))


def calendar_gaps(spark: SparkSession, d: str) -> DataFrame:
    return calendar.missing_months(_order_days(spark, d))


def session_day_gaps(spark: SparkSession, d: str) -> DataFrame:
    return calendar.day_gaps(_order_days(spark, d), 60)


def active_vintages(spark: SparkSession, d: str) -> DataFrame:
    return calendar.active_vintages(calendar.formation_plan(_sessions(spark, d), 2), 3)


def _cross_section(spark: SparkSession, d: str) -> DataFrame:
    """Each month's nations with their three-month trend, where there is one, and their monthly close as capitalization."""
    m = monthly(spark, d)
    scores = study.signal_scores(m, ["trend_3"]).select("symbol", "month", F.col("score").alias("signal"))
    rows = m.join(scores, ["symbol", "month"], "left")
    return rows.select(F.col("month").alias("formation"), F.col("symbol").alias("security_id"), "signal", F.col("close").alias("cap"))


def compound_return(spark: SparkSession, d: str) -> DataFrame:
    """The product over each nation's last six monthly returns."""
    w = study.Window.partitionBy("symbol").orderBy("month")
    moved = monthly(spark, d).withColumn("r", F.col("close") / F.lag("close").over(w) - 1).filter("r is not null")
    series = moved.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "r"))), lambda x: x["r"]).alias("s"))
    return rounded(series.select("symbol", formula.compound_return(F.col("s"), 6).alias("compounded")), "compounded", places=5)


def formula_scores(spark: SparkSession, d: str) -> DataFrame:
    """A compiled formula over the latest values known of two concepts."""
    facts = _selected(spark, d).filter("concept in ('signal_numerator', 'signal_denominator')")
    last = facts.groupBy("security_id", "concept").agg(F.max_by("value", F.struct("period_end", "available_at", "source_id")).alias("value"))
    wide = last.groupBy("security_id").pivot("concept", ["signal_numerator", "signal_denominator"]).agg(F.max(F.expr("try_cast(value as double)")))
    score = formula.compile_formula("(signal_numerator - 1) / signal_denominator * 100", {c: F.col(c) for c in ("signal_numerator", "signal_denominator")})
    return rounded(wide.select("security_id", score.alias("score")).filter("score is not null"), "score")


def bucket_ntile(spark: SparkSession, d: str) -> DataFrame:
    return alloc.buckets(_cross_section(spark, d), 5, 2).select("formation", "security_id", "bucket")


def signal_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return alloc.ordinals(_cross_section(spark, d)).select("formation", "security_id", "ordinal")


def excluded_names(spark: SparkSession, d: str) -> DataFrame:
    return alloc.excluded(_cross_section(spark, d))


def _sleeves(spark: SparkSession, d: str, by_cap: bool) -> DataFrame:
    return alloc.sleeve_weights(alloc.buckets(_cross_section(spark, d), 5, 2), 5, by_cap).select("formation", "security_id", "bucket", "weight")


def equal_weight_sleeves(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_sleeves(spark, d, False), "weight")


def value_weight_sleeves(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_sleeves(spark, d, True), "weight")


def sleeve_totals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(alloc.sleeve_totals(_sleeves(spark, d, True)), "long_total", "short_total")


def turnover_cost(spark: SparkSession, d: str) -> DataFrame:
    """Each month's sleeves against those of the calendar month before."""
    now = _sleeves(spark, d, True)
    before = now.withColumn("formation", F.date_format(F.add_months(F.to_date(F.concat("formation", F.lit("-01"))), 1), "yyyy-MM"))
    return rounded(alloc.turnover_cost(now, before, 6.0, 4.0), "turnover", "commission", "slippage")


def hybrid_score(spark: SparkSession, d: str) -> DataFrame:
    parts = study.signal_scores(monthly(spark, d), ["trend_3", "reversal_1"]).select(F.col("signal").alias("part"), F.col("month").alias("formation"), F.col("symbol").alias("security_id"), "score")
    return rounded(alloc.hybrid_scores(parts, {"trend_3": (0.7, 1), "reversal_1": (0.3, -1)}), "score")


def rank_and_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """events as ideas: one execution for each user and hour, errors blocked."""
    e = load(spark, d, "events")
    ideas = e.select(F.col("event_id").alias("idea_id"), F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd HH")).alias("exec_hash"), (F.col("event_type") == "error").alias("blocked"), "value")
    score = F.col("value") * 0.4 + F.when(F.col("blocked"), 0.0).otherwise(0.3)
    return rounded(alloc.rank_and_dedupe(ideas, score).select("idea_id", "exec_hash", "score", "status"), "score")


def _book(spark: SparkSession, d: str) -> DataFrame:
    """Value-weighted sleeves as a rebalance of a book of a million that still holds last month's shares of each."""
    now = _sleeves(spark, d, True).filter("weight <> 0").select(F.col("formation").alias("batch"), "security_id", F.col("weight"))
    old = F.round(F.col("weight") * 600_000 * (F.length("security_id") - 2) + F.pmod(F.ascii(F.substring("security_id", 3, 1)), F.lit(7)) * 20_000, 2)
    return now.withColumn("old", old)


def post_fee_root(spark: SparkSession, d: str) -> DataFrame:
    return rounded(funding.post_fee_roots(_book(spark, d), 1_000_000.0, 0.001), "root", places=4)


def post_fee_root_exact(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.format_string("%.6f", c)
    return funding.post_fee_roots_exact(_book(spark, d).select("batch", text("weight").alias("weight"), text("old").alias("old"), F.lit("1000000").alias("equity"), F.lit("0.001").alias("cost")))


def whole_share_sizing(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as positions: a target of the discounted price above or below zero, at the price of one unit."""
    li = load(spark, d, "lineitem")
    rows = li.groupBy(F.col("l_suppkey").alias("batch"), F.col("l_partkey").alias("security_id")).agg(F.max("l_extendedprice").alias("target"), F.max("l_quantity").alias("price"), F.count("*").alias("old_shares"))
    rows = rows.withColumn("target", F.when(F.pmod("security_id", F.lit(2)) == 0, F.col("target")).otherwise(-F.col("target")))
    return rounded(funding.whole_shares(rows, 0.001).select("batch", "security_id", "shares", "trade", "fee"), "fee")


def _accounts(spark: SparkSession, d: str) -> DataFrame:
    li, sup = load(spark, d, "lineitem"), load(spark, d, "supplier")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return li.join(sup, li["l_suppkey"] == sup["s_suppkey"]).select(F.col("l_suppkey").alias("account"), (F.col("s_acctbal") * 1000).alias("cash"), signed.alias("notional"))


def collateral_status(spark: SparkSession, d: str) -> DataFrame:
    return rounded(funding.collateral(_accounts(spark, d)), "cash", "restricted", "free", "nav", places=2)


def claim_collateral(spark: SparkSession, d: str) -> DataFrame:
    return rounded(funding.claim_collateral(_accounts(spark, d).select("account", F.col("notional").alias("amount"))), "receivable", "reserved", places=2)


_SELECTED = f"""selected as (select * from facts where available_at <= timestamp '{AT}'
    qualify row_number() over (partition by security_id, concept, period_start, period_end, unit order by available_at desc, revision desc nulls last, source_id, value nulls first) = 1)"""
_LINES = """lines as (select 'S' || l_suppkey security_id, l_returnflag concept, cast(null as date) period_start, cast(o_orderdate as date) period_end, cast(cast(l_extendedprice as decimal(15, 2)) as varchar) "value", 'USD' unit,
    l_shipdate available_at, 'L' || l_partkey source_id, l_linenumber revision from lineitem join orders on l_orderkey = o_orderkey)"""
_LINE_SELECTED = f"{_LINES}, " + _SELECTED.replace("from facts", "from lines").replace(AT, LINES_AT)
_CELLS = f"cells as (select security_id, concept, unit, cast(date_trunc('month', period_end) as date) \"month\", count(*) n, max(value) v from selected where period_start is null and period_end <= date '{CUTOFF}' group by all)"
_VALUES = f"""with {_LINE_SELECTED}, {_CELLS}, one as (select security_id, concept, month, arg_max(value, (period_end, source_id)) v from
      (select *, cast(date_trunc('month', period_end) as date) "month" from selected where period_start is null and period_end <= date '{CUTOFF}') group by security_id, concept, unit, month),
    best as (select security_id, concept, month, max(v) v from one group by all),
    asked as (select distinct security_id, c.concept, cast(m.m as date) "month" from lines, (select unnest({CONCEPTS}) concept) c, (select unnest(generate_series(date_trunc('month', date '{CUTOFF}') - interval {MONTHS - 1} month, date_trunc('month', date '{CUTOFF}'), interval 1 month)) m) m where security_id is not null),
    filled as (select asked.*, v from asked left join best using (security_id, concept, month))"""
_MEMBERS = "members as (select user_id security_id, event_id, event_type <> 'error' included, ts effective_at, ts + interval 1 hour available_at from events)"
_SESS = "s as (select distinct calendar_id, session_date from sessions where calendar_id is not null and session_date is not null)"
_DAYS = "s as (select distinct c_nationkey calendar_id, cast(o_orderdate as date) session_date from orders join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT' and o_orderstatus = 'F' and o_orderdate is not null and c_nationkey is not null)"
_PLAN = f"""{_SESS}, laid as (select *, lead(session_date, 2) over w trade_date, lead(session_date) over w nx from s window w as (partition by calendar_id order by session_date)),
    plan as (select calendar_id, session_date formation_date, trade_date from laid where nx is null or date_trunc('month', nx) <> date_trunc('month', session_date))"""
_CROSS = _signal_sql("trend_3") + ", cs as (select month formation, symbol security_id, score signal, close cap from monthly left join scores using (symbol, month))"
_BUCKETS = _CROSS + """, have as (select *, count(*) over (partition by formation) n from cs where signal is not null),
    bucketed as (select formation, security_id, cap, cast(ntile(5) over (partition by formation order by signal, security_id) - 1 as int) bucket from have where n >= 10)"""
_SLEEVES = _BUCKETS + """, eq as (select formation, security_id, bucket, case bucket when 4 then 1.0 when 0 then -1.0 else 0.0 end / count(*) over (partition by formation, bucket) weight from bucketed),
    vw as (select formation, security_id, bucket, case bucket when 4 then 1.0 when 0 then -1.0 else 0.0 end * cap / sum(cap) over (partition by formation, bucket) weight from bucketed)"""
_BOOK = _SLEEVES + """, book as (select formation batch, security_id, weight w, round(weight * 600000 * (length(security_id) - 2) + (ascii(security_id[3:3]) % 7) * 20000, 2) o from vw where weight <> 0)"""

SQL = {
    "pit_select_facts": f"with {_SELECTED} select security_id, concept, period_start, period_end, unit, available_at, revision, source_id, value from selected",
    "pit_fact_conflicts": f"""with {_LINES}, k as (select * replace (cast(date_trunc('year', period_end) as date) as period_end) from lines where available_at <= timestamp '{LINES_AT}')
        select 'content' kind, security_id, concept, period_start, period_end, unit, revision, count(distinct (value, available_at)) n from k group by security_id, concept, period_start, period_end, unit, source_id, revision having n > 1
        union all select 'value', security_id, concept, period_start, period_end, unit, revision, count(distinct try_cast(value as double)) n from k group by security_id, concept, period_start, period_end, unit, available_at, revision having n > 1""",
    "pit_universe": f"""with {_MEMBERS} select security_id, event_id from (select * from members where available_at <= timestamp '2024-01-20' and effective_at <= timestamp '2024-01-20'
        qualify row_number() over (partition by security_id order by effective_at desc, available_at desc, event_id desc) = 1) where included""",
    "pit_membership_conflicts": f"""with {_MEMBERS} select security_id, cast(effective_at as date) effective_at, cast(available_at as date) available_at, count(distinct included) n, count(*) events from members group by 1, 2, 3 having n > 1""",
    "pit_month_ambiguity": f"with {_LINE_SELECTED}, {_CELLS} select security_id, concept, unit, month, n from cells where n > 1",
    "pit_missing_cells": _VALUES + " select security_id, concept, month from filled where v is null",
    "pit_complete_history": _VALUES + f" select security_id, concept, arg_max(v, month) latest, string_agg(v, '|' order by month) series from filled group by security_id, concept having count(v) = {MONTHS}",
    "pit_facts_in_universe": f"with {_SELECTED} select security_id, concept, period_end, source_id from selected where security_id in (select security_id from formations)",
    "pit_invalid_facts": f"""with {_LINES} select distinct security_id, concept, source_id, period_end, reason from (select *, 'ends_after_known' reason from lines where period_end > cast(available_at as date)
        union all select *, 'begins_after_end' from lines where period_start > period_end)""",
    "exact_quote_marks": """with known as (select security_id, observed_at, min(source_id) s from quotes where available_at <= observed_at group by all), r as (select distinct source_id request_id, security_id, observed_at "at" from quotes where phase = 'close')
        select distinct r.request_id, r.security_id, r.at, s source_id, price_usd from r left join known on r.security_id = known.security_id and r.at = known.observed_at left join (select distinct source_id sid, price_usd from quotes) p on s = sid""",
    "borrow_interval_join": """with g as (select source_id, security_id, available_at, valid_from, valid_through, max(maximum_short_shares) sh from borrow_grants where security_id is not null and valid_from is not null and valid_through is not null and available_at is not null and source_id is not null group by all),
        f as (select distinct formation_id, security_id, trade_at from formations where trade_at is not null and security_id is not null),
        j as (select formation_id, f.security_id, trade_at, count(g.source_id) n, sum(coalesce(try_cast(sh as bigint), 0)) total from f left join g on g.security_id = f.security_id and trade_at >= greatest(valid_from, available_at) and trade_at <= valid_through group by all)
        select formation_id, security_id, n n_active, case n when 1 then 'active' when 0 then 'missing' else 'ambiguous' end status, cast(case when n = 1 then total end as bigint) shares from j""",
    "month_end_sessions": f"with {_SESS} select * from (select calendar_id, cast(date_trunc('month', session_date) as date) \"month\", max(session_date) session_date from s group by 1, 2) where session_date between date '2021-01-15' and date '2022-12-20'",
    "june_rebalances": f"with {_SESS} select calendar_id, cast(date_trunc('month', session_date) as date) \"month\", max(session_date) session_date from s where month(session_date) = 6 group by 1, 2",
    "formation_trade_plan": f"with {_PLAN} select * from plan",
    "calendar_gaps": f"""with {_DAYS}, b as (select calendar_id, date_trunc('month', min(session_date)) a, date_trunc('month', max(session_date)) z from s group by 1),
        spine as (select calendar_id, cast(unnest(generate_series(a, z, interval 1 month)) as date) "month" from b)
        select * from spine where (calendar_id, month) not in (select (calendar_id, cast(date_trunc('month', session_date) as date)) from s)""",
    "session_day_gaps": f"with {_DAYS}, l as (select calendar_id, lag(session_date) over (partition by calendar_id order by session_date) previous_date, session_date from s) select *, cast(session_date - previous_date as int) as days from l where session_date - previous_date > 60",
    "active_vintages": f"with {_PLAN} select calendar_id, cast(unnest(generate_series(date_trunc('month', formation_date) + interval 1 month, date_trunc('month', formation_date) + interval 3 month, interval 1 month)) as date) \"month\", formation_date from plan",
    "compound_return": f"""with {MONTHLY_SQL}, m as (select symbol, month, close / lag(close) over (partition by symbol order by month) - 1 r from monthly),
        l as (select *, row_number() over (partition by symbol order by month desc) k from m where r is not null)
        select symbol, round(case when count(*) >= 6 then product(1 + r) filter (k <= 6) end - 1, 5) compounded from l group by symbol""",
    "formula_scores": f"""with {_SELECTED}, l as (select security_id, concept, try_cast(arg_max(coalesce(value, '~'), (period_end, available_at, source_id)) as double) v from selected where concept in ('signal_numerator', 'signal_denominator') group by 1, 2),
        w as (select security_id, max(v) filter (concept = 'signal_numerator') a, max(v) filter (concept = 'signal_denominator') b from l group by 1)
        select security_id, round((a - 1) / b * 100, 6) score from w where a is not null and b <> 0""",
    "bucket_ntile": _BUCKETS + " select formation, security_id, bucket from bucketed",
    "signal_ordinals": _CROSS + " select formation, security_id, cast(dense_rank() over (partition by formation order by signal) - 1 as int) ordinal from cs where signal is not null",
    "excluded_names": _CROSS + " select formation, string_agg(distinct security_id, ',' order by security_id) excluded, count(distinct security_id) n from cs where signal is null group by 1",
    "equal_weight_sleeves": _SLEEVES + " select formation, security_id, bucket, round(weight, 6) + 0.0 weight from eq",
    "value_weight_sleeves": _SLEEVES + " select formation, security_id, bucket, round(weight, 6) + 0.0 weight from vw",
    "sleeve_totals": _SLEEVES + " select formation, round(sum(weight) filter (weight > 0), 6) long_total, round(sum(weight) filter (weight < 0), 6) short_total, count(*) filter (weight <> 0) n_held from vw group by 1",
    "turnover_cost": _SLEEVES + """, was as (select strftime(cast(formation || '-01' as date) + interval 1 month, '%Y-%m') formation, security_id, weight from vw where weight <> 0),
        j as (select coalesce(a.formation, b.formation) formation, abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) t from (select * from vw where weight <> 0) a full join was b on a.formation = b.formation and a.security_id = b.security_id)
        select formation, round(sum(t), 6) turnover, round(sum(t) * 6 / 1e4, 6) commission, round(sum(t) * 4 / 1e4, 6) slippage from j group by 1""",
    "hybrid_score": _signal_sql("trend_3", "reversal_1") + " select month formation, symbol security_id, round(sum(score * case signal when 'trend_3' then 0.7 else -0.3 end), 6) score from scores group by 1, 2 having count(*) = 2",
    "rank_and_dedupe": """with i as (select event_id, user_id || ':' || strftime(ts, '%Y-%m-%d %H') h, event_type = 'error' b, value * 0.4 + case when event_type = 'error' then 0.0 else 0.3 end sc from events)
        select event_id idea_id, h exec_hash, round(sc, 6) score, case when b then 'blocked' when row_number() over (partition by h, b order by sc desc, event_id) = 1 then 'queued' else 'duplicate' end status from i""",
    "post_fee_root": _BOOK + """, ok as (select batch from book group by batch having 0.001 * sum(abs(w)) < 1 and 0.001 * sum(abs(o)) < 1000000),
        brk as (select distinct batch, o / w b from book where w <> 0 and o / w > 0 and o / w < 1000000 union select batch, 0.0 from ok),
        seg as (select batch, b a, coalesce(lead(b) over (partition by batch order by b), 1000000.0) z from brk),
        aff as (select batch, a, z, sum(case when (a + z) / 2 * w >= o then w else -w end) sw, sum(case when (a + z) / 2 * w >= o then o else -o end) so from seg join book using (batch) group by batch, a, z),
        r as (select batch, a, (1000000 + 0.001 * so) / (1 + 0.001 * sw) v, z from aff)
        select batch, round(arg_min(v, a), 4) root from r join ok using (batch) where v >= a - 1e-9 and v <= z + 1e-9 group by batch""",
    # in integers of a millionth: what the book costs at each name's own break point tells on which side of the root that lies
    "post_fee_root_exact": _BOOK + """, n as (select batch, security_id, cast(round(w * 1000000) as hugeint) w, cast(round(o * 1000000) as hugeint) o from book),
        ok as (select batch from n group by 1 having sum(abs(w)) < 1000000000 and sum(abs(o)) < 1000000000000000),
        turn as (select a.batch, a.security_id, a.w, a.o, sign(a.w)::hugeint * a.o * 1000000000 + sum(abs(sign(a.w)::hugeint * a.o * b.w - b.o * abs(a.w))) < 1000000000000000 * abs(a.w) below
                 from n a join n b using (batch) where a.w <> 0 group by a.batch, a.security_id, a.w, a.o),
        total as (select batch, sum(case when below then abs(w) else -abs(w) end)::hugeint s, sum(case when below then -sign(w)::hugeint * o else sign(w)::hugeint * o end)::hugeint l from turn group by 1),
        fixed as (select batch, coalesce(sum(abs(o)) filter (w = 0), 0)::hugeint f from n group by 1),
        r as (select batch, 1000000000000000::hugeint - l - f p, 1000000000::hugeint + s q from total join fixed using (batch) join ok using (batch))
        select fixed.batch, cast(p // gcd(p, q) as varchar) num, cast(q // gcd(p, q) as varchar) den from fixed left join r using (batch)""",
    "whole_share_sizing": """with r as (select l_suppkey batch, l_partkey security_id, max(l_extendedprice) * case when l_partkey % 2 = 0 then 1 else -1 end t, max(l_quantity) p, count(*) o from lineitem group by 1, 2),
        q as (select *, cast(trunc(t / p) as bigint) shares from r) select batch, security_id, shares, shares - o trade, round(abs((shares - o) * p) * 0.001, 6) fee from q""",
    "collateral_status": """with a as (select l_suppkey account, max(s_acctbal) * 1000 cash, sum(case when l_returnflag = 'R' then l_extendedprice else 0.0 end) rs, sum(case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end) net from lineitem join supplier on l_suppkey = s_suppkey group by 1)
        select account, round(cash, 2) cash, round(rs, 2) restricted, round(cash - rs, 2) "free", round(cash + net, 2) nav, case when cash + net <= 0 then 'insolvent' when cash - rs < 0 then 'unfunded' else 'funded' end status from a""",
    "claim_collateral": "select l_suppkey account, round(sum(case when l_returnflag <> 'R' then l_extendedprice else 0 end), 2) receivable, round(sum(case when l_returnflag = 'R' then l_extendedprice else 0 end), 2) reserved, count(*) n_claims from lineitem join supplier on l_suppkey = s_suppkey group by 1",
}

QUERIES = {
    q.__name__: q
    for q in (
        pit_select_facts, pit_fact_conflicts, pit_universe, pit_membership_conflicts, pit_month_ambiguity, pit_missing_cells, pit_complete_history, pit_facts_in_universe, pit_invalid_facts, exact_quote_marks, borrow_interval_join,
        month_end_sessions, june_rebalances, formation_trade_plan, calendar_gaps, session_day_gaps, active_vintages, compound_return, formula_scores, bucket_ntile, signal_ordinals, excluded_names, equal_weight_sleeves, value_weight_sleeves,
        sleeve_totals, turnover_cost, hybrid_score, rank_and_dedupe, post_fee_root, post_fee_root_exact, whole_share_sizing, collateral_status, claim_collateral,
    )
}
