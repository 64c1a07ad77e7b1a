"""Queries of accounts with corporate actions, budgets and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import budgets, ledger, replay, stats, study, validation
from tidemark.plans.records import _FOLDS, _labels, _series
from tidemark.plans.study import _RETURNS_SQL, _capped, rounded
from tidemark.plans.views import DAILY_SQL, NATION_SQL, PANEL_SQL, monthly, segment_panel
from tidemark.tables import load

AS_OF, SPLIT_DAY, DIVIDEND_DAY, EXIT_DAY, FEE_BPS = 10_250, 9_000, 9_800, 10_200, 4.0
CAP, DEADLINE = 60_000_000, 10_400


def _books(spark: SparkSession, d: str) -> replay.Books:
    """Order lines as fills of their supplier's account, returned ones as sales; parts split, pay and leave by their key."""
    li = load(spark, d, "lineitem")
    day = F.unix_date(F.to_date("l_shipdate")).cast("bigint")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    fills = li.select(F.col("l_suppkey").alias("account"), F.col("l_partkey").alias("security_id"), day.alias("t"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("fill_id"), signed.alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    p = load(spark, d, "part").select(F.col("p_partkey").alias("security_id"), F.col("p_retailprice").alias("price"))
    none = F.lit(None)
    row = lambda t, kind, old, new, cash, pay, offset: p.select("security_id", (F.col("security_id") * 4 + offset).alias("action_id"), F.lit(t).cast("bigint").alias("t"), F.lit(kind).alias("kind"), F.lit(old).cast("double").alias("old_shares"), F.lit(new).cast("double").alias("new_shares"), cash.cast("double").alias("cash_per_share"), F.lit(pay).cast("bigint").alias("pay_at"))
    actions = row(SPLIT_DAY, "split", 1, 2, none, None, 0).filter("security_id % 5 = 0")
    actions = actions.unionByName(row(SPLIT_DAY + 300, "split", 2, 1, none, None, 1).filter("security_id % 10 = 0"))
    actions = actions.unionByName(row(DIVIDEND_DAY, "dividend", None, None, F.col("price") / 100, DIVIDEND_DAY + 30, 2).filter("security_id % 3 = 0"))
    actions = actions.unionByName(row(EXIT_DAY, "terminal_exit", None, None, F.when(F.col("security_id") % 14 != 1, F.col("price") / 2), EXIT_DAY + 90, 3).filter("security_id % 7 = 1"))
    actions = actions.unionByName(row(EXIT_DAY + 20, "dividend", None, None, F.col("price") / 100, EXIT_DAY + 40, 4).filter("security_id % 21 = 1"))
    initial = load(spark, d, "supplier").select(F.col("s_suppkey").alias("account"), (F.col("s_acctbal") * 1000).alias("cash"))
    return replay.replay(fills, actions, initial, FEE_BPS, AS_OF)


def replay_positions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_books(spark, d).positions, "shares", places=4)


def replay_balances(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_books(spark, d).balances, "cash", "fees", "claims", places=2)


def replay_claims(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_books(spark, d).claims, "amount", places=4)


def replay_nav(spark: SparkSession, d: str) -> DataFrame:
    prices = load(spark, d, "part").filter("p_size > 2").select(F.col("p_partkey").alias("security_id"), F.col("p_retailprice").alias("price"))
    return rounded(replay.net_asset_value(_books(spark, d), prices), "nav", places=1)


def replay_violations(spark: SparkSession, d: str) -> DataFrame:
    return _books(spark, d).violations.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("security_id").alias("securities"), F.min("t").alias("first_t"))


def cash_two_ways(spark: SparkSession, d: str) -> DataFrame:
    """Accounts whose cash by running totals and by a second derivation, in whole cents for each fill, agree."""
    li = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("account"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("fill_id"), F.lit(1.0).alias("quantity"), F.col("l_extendedprice").alias("price"))
    steps = replay.cash_steps(li, 100.0)
    running = ledger.running_totals(steps.withColumn("cents", F.round(F.col("cash_step") * 10_000).cast("bigint")), "account", F.col("fill_id.l_orderkey"), ["fill_id"], {"total": "cents"})
    last = running.groupBy("account").agg(F.max_by("total", "fill_id").cast("bigint").alias("cash"))
    exact = li.groupBy("account").agg((-F.sum((F.col("price").cast("decimal(15,2)") * 10_100).cast("bigint"))).cast("bigint").alias("cash"))
    return last.join(exact.withColumnRenamed("cash", "second"), "account").select("account", "cash", "second", (F.col("cash") == F.col("second")).alias("agrees"))


def _operations(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders in turn as reservations; finished ones are settled at nine tenths, the day after."""
    o = load(spark, d, "orders")
    at = F.unix_date(F.to_date("o_orderdate")).cast("bigint")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    base = o.select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("k"), at.alias("at"), cents.alias("cents"), "o_orderstatus")
    reserve = base.select("account", (F.col("k") * 2).alias("seq"), "at", F.col("k").cast("string").alias("operation_id"), F.lit("reserve").alias("kind"), F.col("cents").alias("amount"))
    settle = base.filter("o_orderstatus = 'F'").select("account", (F.col("k") * 2 + 1).alias("seq"), "at", F.col("k").cast("string").alias("operation_id"), F.lit("settle").alias("kind"), F.floor(F.col("cents") * 9 / 10).cast("bigint").alias("amount"))
    return reserve.unionByName(settle)


def budget_decisions(spark: SparkSession, d: str) -> DataFrame:
    return budgets.decide(_operations(spark, d), CAP, DEADLINE)


def budget_violations(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders as a history in order of key, numbered from 0, of which every 50th was lost."""
    o = load(spark, d, "orders")
    seq = F.row_number().over(ledger.Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = o.select(F.col("o_custkey").alias("account"), seq.cast("bigint").alias("seq"), F.unix_date(F.to_date("o_orderdate")).alias("at"), F.lit("reserve").alias("kind"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("change"), "o_orderkey")
    return budgets.history_violations(rows.filter("o_orderkey % 50 <> 7").drop("o_orderkey"), 300_000_000, DEADLINE)


def batch_ceilings(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return budgets.within_ceiling(o.select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("case_id"), F.round(F.col("o_totalprice")).cast("bigint").alias("allowance")), 2_000_000)


def fold_assessment(spark: SparkSession, d: str) -> DataFrame:
    """Test blocks of 60 days of each segment's price, the last of which may be too short for five lags."""
    rows = _labels(spark, d).withColumnRenamed("price", "value")
    out = validation.fold_diagnostics(rows, 200, 60, 5)
    return rounded(out.withColumn("mean", F.col("mean") / 1000).withColumn("variance_mean", F.col("variance_mean") / 1e6), "mean", "variance_mean", "t_statistic", places=4)


def research_validation(spark: SparkSession, d: str) -> DataFrame:
    statuses = _capped(spark, d).select(F.col("symbol").alias("series")).distinct().withColumn("status", F.when(F.col("series") == "BUILDING", "failed").otherwise("completed"))
    rows = _series(spark, d).withColumn("value", F.col("value") * 100)
    rows = rows.filter("series <> 'FURNITURE' or idx < 30")
    return rounded(validation.validate_series(rows, statuses, 60, 4, True), "mean", "t_statistic", places=5)


def close_path_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Nations whose months are not those on which the segment BUILDING was traded."""
    calendar = segment_panel(spark, d).filter("symbol = 'BUILDING'").select(F.date_format("date", "yyyy-MM").alias("at"))
    closes = monthly(spark, d).filter("symbol not in ('N03', 'N07') or month < '1998-01'").select(F.col("symbol").alias("series"), F.col("month").alias("at"), F.col("close").alias("nav"))
    return validation.returns_of_closes(closes, calendar)[1].withColumn("missing", F.col("missing").cast("bigint"))


def close_path_returns(spark: SparkSession, d: str) -> DataFrame:
    calendar = segment_panel(spark, d).filter("symbol = 'BUILDING'").select(F.date_format("date", "yyyy-MM").alias("at"))
    closes = segment_panel(spark, d).groupBy("symbol", F.date_format("date", "yyyy-MM").alias("at")).agg(F.max_by("price", "date").alias("nav"))
    moved, _ = validation.returns_of_closes(closes.withColumnRenamed("symbol", "series"), calendar)
    return rounded(stats.hac_mean(moved, 3), "mean", "variance_mean", "standard_error", "t_statistic", places=5)


def short_histories(spark: SparkSession, d: str) -> DataFrame:
    return validation.too_short(monthly(spark, d).filter("symbol > 'N10' or month < '1997-01'"))


def risk_free_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Monthly returns of segments against rates of the same interval, of which some are missing, late or told twice."""
    w = ledger.Window.partitionBy("symbol").orderBy("month")
    rets = _capped(spark, d).select(F.col("symbol").alias("series"), F.lag("month").over(w).alias("start_at"), F.col("month").alias("end_at"), F.col("r").alias("ret")).filter("start_at is not null")
    months = rets.select("start_at", "end_at").distinct()
    year = F.substring("end_at", 1, 4).cast("int")
    rates = months.filter("end_at not like '%-07'").select("start_at", "end_at", F.when(F.col("end_at").like("%-03"), "9999-12").otherwise(F.col("end_at")).alias("available_at"), (year / 1e6).alias("rate"))
    rates = rates.unionByName(months.filter("end_at like '%-09'").select("start_at", "end_at", F.col("end_at").alias("available_at"), F.lit(0.5).alias("rate")))
    out = validation.aligned_intervals(rets, rates, F.lit("9998-01"))
    return out.groupBy("series", "reason").agg(F.count("*").alias("n"), F.round(F.sum("rate"), 6).alias("rates"))


def study_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status and priority as declared cases; those found leave some out, add some, and count some wrong."""
    o = load(spark, d, "orders")
    cases = o.select(F.col("o_orderpriority").alias("signal"), F.year("o_orderdate").alias("cost_bps"), F.col("o_orderkey").alias("month"))
    declared = cases.select("signal", "cost_bps").distinct()
    found = cases.groupBy("signal", "cost_bps").agg(F.count("*").alias("n")).filter("signal <> '5-LOW' or cost_bps < 1996")
    found = found.withColumn("n", F.when(F.col("cost_bps") == 1994, F.col("n") + 1).otherwise(F.col("n"))).unionByName(found.filter("cost_bps = 1995")).unionByName(found.limit(0).sparkSession.createDataFrame([("6-NEW", 1999, 0)], "signal string, cost_bps int, n bigint"))
    li = load(spark, d, "lineitem").filter("l_partkey % 97 = 3")
    return validation.study_violations(declared, found, cases, li.select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id")))


def study_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each segment's return series with its total, Sharpe ratio, fall and HAC statistic."""
    base = study.performance(_capped(spark, d), ["symbol"], "month", "r")
    hac = stats.hac_mean(_series(spark, d), 3).select(F.col("series").alias("symbol"), "t_statistic")
    return rounded(base.join(hac, "symbol", "left"), "total_return", "sharpe", "max_drawdown", "t_statistic", places=5)


_BOOKS = f"""lines as (select l_suppkey account, l_partkey k, cast(l_shipdate as date) - date '1970-01-01' t, case when l_returnflag = 'R' then -l_quantity else l_quantity end q, l_extendedprice / l_quantity price, p_retailprice rp from lineitem join part on p_partkey = l_partkey),
    upto as (select *, case when k % 5 = 0 and t >= {SPLIT_DAY} then 2.0 else 1 end / case when k % 10 = 0 and t >= {SPLIT_DAY + 300} then 2.0 else 1 end f, case when k % 5 = 0 then 2.0 else 1 end / case when k % 10 = 0 then 2.0 else 1 end fl from lines where t <= {AS_OF}),
    ok as (select * from upto where k % 7 <> 1 or t < {EXIT_DAY}),
    held as (select account, k, any_value(rp) rp, sum(q / f * fl) sh, coalesce(sum(q / f * fl) filter (t < {DIVIDEND_DAY}), 0) dv from ok group by 1, 2),
    owed as (select account, k * 4 + 2 action_id, k security_id, {DIVIDEND_DAY + 30} pay_at, round(dv, 9) * rp / 100 amount from held where k % 3 = 0 and abs(dv) > 1e-9
      union all select account, k * 4 + 3, k, {EXIT_DAY + 90}, round(sh, 9) * rp / 2 from held where k % 7 = 1 and k % 14 <> 1 and abs(sh) > 1e-9),
    bal as (select account, sum(cash) cash, sum(fees) fees, sum(claims) claims from (
      select account, -q * price - abs(q * price) * {FEE_BPS} / 1e4 cash, abs(q * price) * {FEE_BPS} / 1e4 fees, 0.0 claims from ok
      union all select account, case when pay_at <= {AS_OF} then amount else 0 end, 0, case when pay_at <= {AS_OF} then 0 else amount end from owed
      union all select s_suppkey, s_acctbal * 1000, 0, 0 from supplier) group by 1)"""

SQL = {
    "replay_positions": f"with {_BOOKS} select account, k security_id, case when k % 7 = 1 then 0.0 else round(sh, 4) end shares from held",
    "replay_balances": f"with {_BOOKS} select account, round(cash, 2) cash, round(fees, 2) fees, round(claims, 2) claims from bal",
    "replay_claims": f"with {_BOOKS} select account, action_id, security_id, cast(pay_at as bigint) pay_at, round(amount, 4) amount from owed where pay_at > {AS_OF}",
    "replay_nav": f"""with {_BOOKS}, w as (select account, sum(coalesce(sh * p_retailprice, 0)) w, count(*) filter (p_retailprice is null) u from held left join (select * from part where p_size > 2) on p_partkey = k where k % 7 <> 1 and abs(sh) > 1e-9 group by 1)
        select account, round(cash + claims + coalesce(w, 0), 1) nav, coalesce(u, 0) unpriced from bal left join w using (account)""",
    "replay_violations": f"""with {_BOOKS} select 'trade_after_exit' reason, count(*) n, count(distinct k) securities, cast(min(t) as bigint) first_t from upto where k % 7 = 1 and t >= {EXIT_DAY}
        union all select 'action_after_exit', count(*), count(*), {EXIT_DAY + 20} from part where p_partkey % 21 = 1
        union all select 'unknown_exit', count(*), count(distinct k), {EXIT_DAY} from held where k % 14 = 1 and abs(sh) > 1e-9""",
    "cash_two_ways": "select l_suppkey account, -cast(sum(cast(round(l_extendedprice * 10100) as bigint)) as bigint) cash, -cast(sum(cast(round(l_extendedprice * 10100) as bigint)) as bigint) \"second\", true agrees from lineitem group by 1",
    "budget_decisions": f"""with recursive e as (select o_custkey account, o_orderkey k, cast(o_orderdate as date) - date '1970-01-01' t, cast(round(o_totalprice * 100) as bigint) c, o_orderstatus = 'F' f, row_number() over (partition by o_custkey order by o_orderkey) i from orders),
        b as (select account, k, i, f, cast(0 as bigint) before, -1 clock, c, t, case when t >= {DEADLINE} then 'past_deadline' when c > {CAP} then 'over_capacity' else 'granted' end o from e where i = 1
          union all select account, k, i, f, before, clock, c, t, case when t >= {DEADLINE} then 'past_deadline' when t < clock then 'clock_back' when before + c > {CAP} then 'over_capacity' else 'granted' end
          from (select e.*, b.before + case when b.o = 'granted' then case when b.f then cast(floor(b.c * 9 / 10) as bigint) else b.c end else 0 end before, case when b.o = 'granted' then b.t else b.clock end clock from b join e on e.account = b.account and e.i = b.i + 1))
        select cast(account as varchar) account, k * 2 seq, cast(k as varchar) operation_id, 'reserve' kind, o outcome, before + case when o = 'granted' then c else 0 end committed from b
        union all select cast(account as varchar), k * 2 + 1, cast(k as varchar), 'settle', case when o = 'granted' then 'settled' else 'unreserved' end, before + case when o = 'granted' then cast(floor(c * 9 / 10) as bigint) else 0 end from b where f""",
    "budget_violations": f"""with o as (select o_custkey account, row_number() over (partition by o_custkey order by o_orderkey) - 1 seq, cast(o_orderdate as date) - date '1970-01-01' t, cast(round(o_totalprice * 100) as bigint) c, o_orderkey k from orders),
        w as (select *, lag(seq) over p b, sum(c) over p s, max(t) over (partition by account order by seq rows between unbounded preceding and 1 preceding) h from o where k % 50 <> 7 window p as (partition by account order by seq))
        select account, seq, unnest(list_filter([case when seq <> coalesce(b + 1, 0) then 'sequence' end, case when t < h then 'clock_back' end, case when t >= {DEADLINE} then 'past_deadline' end, case when s > 300000000 then 'over_capacity' end], lambda x: x is not null)) reason from w""",
    "batch_ceilings": "select o_custkey batch, cast(sum(a) as bigint) total, sum(a) <= 2000000 admitted from (select o_custkey, o_orderkey, max(cast(round(o_totalprice) as bigint)) a from orders group by 1, 2) group by 1",
    "fold_assessment": _FOLDS + """, x as (select series, fold, idx, price v, row_number() over (partition by series, fold order by idx) i from folds where "role" = 'test'), c as (select series, fold, count(*) filter ("role" = 'test') n, count(*) filter ("role" = 'train') n_train, count(*) filter ("role" = 'purged') n_purged from folds group by 1, 2),
        u as (select series, fold, i, v - avg(v) over (partition by series, fold) u from x), m as (select series, fold, avg(v) m, count(*) n from x group by 1, 2), a as (select series, fold, sum(u * u) s0 from u group by 1, 2),
        l as (select a.series, a.fold, sum(2 * (1 - (a.i - b.i) / 6.0) * a.u * b.u) s1 from u a join u b on a.series = b.series and a.fold = b.fold and a.i - b.i between 1 and 5 group by 1, 2),
        res as (select m.series, m.fold, m, greatest(0, (s0 + s1) / (n * n)) vm from m join a using (series, fold) join l using (series, fold) where n > 5)
        select series, cast(fold as int) fold, n, n_train, n_purged, round(m / 1000, 4) mean, round(vm / 1e6, 4) variance_mean, round(case when vm > 0 then m / sqrt(vm) end, 4) t_statistic, case when m is null then 'INSUFFICIENT_HAC_SAMPLE' end reason from c left join res using (series, fold)""",
    "research_validation": _RETURNS_SQL + """, s as (select symbol series, r * 100 v, row_number() over (partition by symbol order by month) i from rets), x as (select * from s where series <> 'FURNITURE' or i <= 30), k as (select series, count(*) n, avg(v) m from x group by 1),
        u as (select x.series, i, v - m u, n from x join k using (series)), a as (select series, sum(u * u) s0 from u group by 1), l as (select a.series, sum(2 * (1 - (a.i - b.i) / 5.0) * a.u * b.u) s1 from u a join u b on a.series = b.series and a.i - b.i between 1 and 4 group by 1)
        select series, n, case when series <> 'BUILDING' then round(m, 5) end mean, case when series <> 'BUILDING' then round(m / sqrt(greatest(0, (s0 + s1) / (n * n) * (n / (n - 1.0)))), 5) end t_statistic,
          case when series = 'BUILDING' then 'EXPERIMENT_NOT_COMPLETED' when n <= 60 then 'INSUFFICIENT_SPLIT_SAMPLE' end reason from k join a using (series) join l using (series)""",
    "close_path_gaps": f"""with {NATION_SQL}, m as (select distinct symbol series, strftime(date, '%Y-%m') \"at\" from panel where symbol not in ('N03', 'N07') or strftime(date, '%Y-%m') < '1998-01'), {PANEL_SQL.replace('panel as', 'seg as')},
        c as (select distinct strftime(date, '%Y-%m') \"at\" from seg where symbol = 'BUILDING'), j as (select series, count(c.at) have, count(*) filter (c.at is null) extra from m left join c on m.at = c.at group by 1)
        select series, (select count(*) from c) - have missing, extra from j where have <> (select count(*) from c) or extra > 0""",
    "close_path_returns": f"""with {PANEL_SQL}, k as (select symbol series, strftime(date, '%Y-%m') \"at\", arg_max(price, date) nav from panel group by 1, 2), c as (select \"at\" from k where series = 'BUILDING'),
        g as (select series from k left join c on k.at = c.at group by 1 having count(c.at) = (select count(*) from c) and count(*) = count(c.at)),
        s as (select series, nav / lag(nav) over (partition by series order by \"at\") - 1 v, row_number() over (partition by series order by \"at\") i from k where series in (select series from g)), x as (select * from s where v is not null), m as (select series, count(*) n, avg(v) m from x group by 1),
        u as (select x.series, i, v - m u, n from x join m using (series)), a as (select series, sum(u * u) s0 from u group by 1), l as (select a.series, sum(2 * (1 - (a.i - b.i) / 4.0) * a.u * b.u) s1 from u a join u b on a.series = b.series and a.i - b.i between 1 and 3 group by 1),
        f as (select series, n, m, greatest(0, (s0 + s1) / (n * n)) vm from m join a using (series) join l using (series)) select series, n, round(m, 5) mean, round(vm, 5) variance_mean, round(sqrt(vm), 5) standard_error, round(m / sqrt(vm), 5) t_statistic from f""",
    "short_histories": f"with {NATION_SQL}, m as (select distinct symbol, strftime(date, '%Y-%m') mo from panel where symbol > 'N10' or strftime(date, '%Y-%m') < '1997-01') select symbol, count(*) \"months\" from m group by 1 having count(*) < 85",
    "risk_free_alignment": _RETURNS_SQL + """, x as (select symbol series, lag(month) over (partition by symbol order by month) s, month e from rets), y as (select *, cast(e[1:4] as int) / 1e6 r from x where s is not null),
        z as (select *, case when e like '%-07' then 'risk_free_missing' when e like '%-09' then 'risk_free_ambiguous' when e like '%-03' then 'risk_free_late' end reason from y)
        select series, reason, count(*) n, round(sum(case when reason is null then r end), 6) rates from z group by 1, 2""",
    "study_inventory": """with c as (select o_orderpriority s, year(o_orderdate) y, count(*) n from orders group by 1, 2), f as (select * from c where s <> '5-LOW' or y < 1996)
        select 'case_missing' reason, s || '/' || y item from c where s = '5-LOW' and y >= 1996 union all select 'case_undeclared', '6-NEW/1999' union all select 'case_repeated', s || '/' || y from f where y = 1995
        union all select 'periods_differ', s || '/' || y from f where y = 1994
        union all select 'span_repeated', l_orderkey || '/' || l_linenumber from lineitem where l_partkey % 97 = 3 group by l_orderkey, l_linenumber having count(*) > 1""",
    "study_summary": _RETURNS_SQL + """, s as (select symbol, r v, row_number() over (partition by symbol order by month) i, product(1 + r) over (partition by symbol order by month) nav from rets), q as (select *, nav / greatest(1.0, max(nav) over (partition by symbol order by i)) - 1 fall from s),
        k as (select symbol, count(*) n, avg(v) m, stddev_samp(v) sd, arg_max(nav, i) - 1 tr, min(fall) dd from q group by 1), u as (select s.symbol, i, v - m u from s join k using (symbol)), a as (select symbol, sum(u * u) s0 from u group by 1),
        l as (select a.symbol, sum(2 * (1 - (a.i - b.i) / 4.0) * a.u * b.u) s1 from u a join u b on a.symbol = b.symbol and a.i - b.i between 1 and 3 group by 1)
        select symbol, n, round(tr, 5) total_return, round(sqrt(12.0) * m / sd, 5) sharpe, round(dd, 5) max_drawdown, round(m / sqrt(greatest(0, (s0 + s1) / (n * n))), 5) t_statistic from k join a using (symbol) join l using (symbol)""",
}

QUERIES = {
    q.__name__: q
    for q in (
        replay_positions, replay_balances, replay_claims, replay_nav, replay_violations, cash_two_ways, budget_decisions, budget_violations, batch_ceilings, fold_assessment, research_validation, close_path_gaps, close_path_returns,
        short_histories, risk_free_alignment, study_inventory, study_summary,
    )
}
