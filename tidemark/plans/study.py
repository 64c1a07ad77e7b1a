"""Queries of the cross-sectional study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import study
from tidemark.plans.views import DAILY_SQL, MONTHLY_SQL, PANEL_SQL, monthly, segment_panel


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def daily_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.daily_returns(segment_panel(spark, d)), "price", "daily_return")


def monthly_ohlc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(monthly(spark, d), "first_price", "close", "daily_max")


def monthly_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.month_end_panel(segment_panel(spark, d)), "price", "previous_price", "monthly_return")


def month_gaps(spark: SparkSession, d: str) -> DataFrame:
    return study.month_gaps(monthly(spark, d))


def _signals(*prefixes: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        names = [n for n in _names() if n.startswith(prefixes)]
        return rounded(study.signal_scores(monthly(spark, d), names), "score")

    return query


def _names() -> list[str]:
    return [
        *(f"momentum_{n}_skip1" for n in study.MOMENTUM), *(f"reversal_{n}" for n in study.REVERSAL), *(f"trend_{n}" for n in study.TREND),
        *(f"low_volatility_{n}" for n in study.VOLATILITY), *(f"low_downside_{n}" for n in study.DOWNSIDE), "low_max_daily_1",
    ]


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return study.long_short_weights(study.signal_scores(monthly(spark, d)))


def long_short_weights(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d)


def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.forward_returns(monthly(spark, d)), "forward")


def _gross(spark: SparkSession, d: str) -> DataFrame:
    return study.portfolio_gross(_weights(spark, d), study.forward_returns(monthly(spark, d)))


def period_return_gross(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_gross(spark, d), "gross")


def _capped(spark: SparkSession, d: str) -> DataFrame:
    """Monthly mean daily returns of each segment: a return series that stays above -1."""
    panel = study.daily_returns(segment_panel(spark, d)).filter("daily_return is not null")
    return panel.groupBy("symbol", F.date_format("date", "yyyy-MM").alias("month")).agg((F.avg("daily_return") / 100).alias("r"))


def study_sharpe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.performance(_capped(spark, d), ["symbol"], "month", "r").select("symbol", "n", "sharpe"), "sharpe")


def max_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.performance(_capped(spark, d), ["symbol"], "month", "r").select("symbol", "total_return", "max_drawdown"), "total_return", "max_drawdown")


def cumulative_nav(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.cumulative_nav(_capped(spark, d), ["symbol"], "month", "r").select("symbol", "month", "nav"), "nav")


def period_return_net(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study.portfolio_net(_weights(spark, d), study.forward_returns(monthly(spark, d))), "turnover", "fee", "net")


def signal_cost_grid(spark: SparkSession, d: str) -> DataFrame:
    net = study.portfolio_net(_weights(spark, d), study.forward_returns(monthly(spark, d)))
    grid = net.groupBy("signal", "cost_bps").agg(F.count("*").alias("months"), F.avg("net").alias("mean_net"), F.sum("fee").alias("fees"), F.max_by("status", "month").alias("status"))
    return rounded(grid, "mean_net", "fees")


_W = "over (partition by symbol order by month)"


def _signal_sql(*prefixes: str) -> str:
    full = lambda n: f"count(r) over (partition by symbol order by month rows between {n - 1} preceding and current row) = {n}"
    rows = lambda n: f"over (partition by symbol order by month rows between {n - 1} preceding and current row)"
    parts = {f"momentum_{n}_skip1": f"lag(close, 1) {_W} / lag(close, {n}) {_W} - 1" for n in study.MOMENTUM}
    parts |= {f"reversal_{n}": f"-(close / lag(close, {n}) {_W} - 1)" for n in study.REVERSAL}
    parts |= {f"trend_{n}": f"case when count(close) {rows(n)} = {n} then close / avg(close) {rows(n)} - 1 end" for n in study.TREND}
    parts |= {f"low_volatility_{n}": f"case when {full(n)} then -stddev_samp(r) {rows(n)} end" for n in study.VOLATILITY}
    parts |= {f"low_downside_{n}": f"case when {full(n)} then -sqrt(avg(least(r, 0.0) * least(r, 0.0)) {rows(n)}) end" for n in study.DOWNSIDE}
    parts["low_max_daily_1"] = "-daily_max"
    union = " union all ".join(f"select '{n}' signal, symbol, month, {e} score from moved" for n, e in parts.items() if n.startswith(prefixes))
    return f"with {MONTHLY_SQL}, moved as (select *, close / lag(close) {_W} - 1 r from monthly), scores as (select * from ({union}) where score is not null)"


_WEIGHTS_SQL = _signal_sql("") + """,
  ranked as (select *, row_number() over (partition by signal, month order by score, symbol) rk, count(*) over (partition by signal, month) n from scores),
  weights as (select signal, month, symbol, case when rk <= 2 then -0.5 when rk > n - 2 then 0.5 else 0.0 end::double weight from ranked where n >= 4)"""
_FORWARD_SQL = f"forwards as (select * from (select symbol, month, lead(first_price, 2) {_W} / lead(first_price, 1) {_W} - 1 forward from monthly) where forward is not null)"
_RETURNS_SQL = f"with {PANEL_SQL}, {DAILY_SQL}, rets as (select symbol, strftime(date, '%Y-%m') \"month\", avg(daily_return) / 100 r from daily where daily_return is not null group by all)"
_NAV_SQL = _RETURNS_SQL + ", navs as (select *, product(1 + r) over w nav from rets window w as (partition by symbol order by month rows unbounded preceding))"

#: The recurrence as a recursive query over (signal, cost): only the net return goes from month to month.
_NET_SQL = _WEIGHTS_SQL.replace("with ", "with recursive ", 1) + f""", {_FORWARD_SQL},
    held as (select signal, month, symbol, weight w, weight * (1 + forward) g from weights join forwards using (symbol, month) where weight <> 0),
    mon as (select *, lead(month) over (partition by signal order by month) nx, row_number() over (partition by signal order by month) t from (select signal, month, sum(g) - sum(w) gross, sum(abs(g)) ending from held group by 1, 2)),
    sides as (select signal, month, symbol, w, 0::double b from held union all select h.signal, nx, symbol, 0::double, g from held h join mon using (signal, month) where nx is not null),
    pairs as (select signal, month, list({{'w': w, 'b': b}}) ps from (select signal, month, symbol, sum(w) w, sum(b) b from sides group by all) group by 1, 2),
    path as (select signal, month, t, gross, case when nx is null then ending else 0.0 end sold, ps from mon join pairs using (signal, month)),
    net as (select signal, cost_bps, t, month, tu turnover, (tu + sold) * cost_bps / 1e4 fee, gross - (tu + sold) * cost_bps / 1e4 net
            from (select *, list_sum(list_transform(ps, lambda p: abs(p.w - p.b))) tu from path, (select unnest({list(study.COSTS_BPS)}) cost_bps) where t = 1)
      union all select signal, cost_bps, t, month, tu, (tu + sold) * cost_bps / 1e4, gross - (tu + sold) * cost_bps / 1e4
            from (select path.*, cost_bps, list_sum(list_transform(ps, lambda p: abs(p.w - p.b / (1 + net.net)))) tu from net join path on path.signal = net.signal and path.t = net.t + 1 where net.net > -1))"""

SQL = {
    "period_return_net": _NET_SQL + " select signal, cost_bps, month, round(turnover, 6) turnover, round(fee, 6) fee, round(net, 6) net, case when net <= -1 then 'insolvent' else 'complete' end status from net",
    "signal_cost_grid": _NET_SQL + """ select signal, cost_bps, count(*) "months", round(avg(net), 6) mean_net, round(sum(fee), 6) fees, case when min(net) <= -1 then 'insolvent' else 'complete' end status from net group by 1, 2""",
    "daily_returns": f"with {PANEL_SQL}, {DAILY_SQL} select symbol, date, round(price, 6) price, round(daily_return, 6) daily_return from daily",
    "monthly_ohlc": f"with {MONTHLY_SQL} select symbol, month, first_date, round(first_price, 6) first_price, round(close, 6) \"close\", round(daily_max, 6) daily_max from monthly",
    "monthly_panel": f"""with {PANEL_SQL}, ends as (select * from panel qualify row_number() over (partition by symbol, strftime(date, '%Y-%m') order by date desc) = 1),
        prev as (select *, lag(date) over w previous_date, lag(price) over w pp from ends window w as (partition by symbol order by date))
        select symbol, date, round(price, 6) price, previous_date, round(pp, 6) previous_price, round(price / pp - 1, 6) monthly_return, cast(year(date) as int) "year" from prev""",
    "month_gaps": f"""with {MONTHLY_SQL}, numbered as (select symbol, month, lag(month) {_W} previous_month, cast(month[1:4] as int) * 12 + cast(month[6:7] as int) k from monthly)
        select * from (select symbol, month, previous_month, cast(k - lag(k) {_W} as int) step from numbered) where step <> 1""",
    **{f"signal_{k}": _signal_sql(*p) + " select signal, symbol, month, round(score, 6) score from scores" for k, p in {"momentum": ("momentum",), "reversal": ("reversal",), "trend": ("trend",), "low_volatility": ("low_volatility",), "low_downside": ("low_downside",), "low_max_daily": ("low_max",)}.items()},
    "long_short_weights": _WEIGHTS_SQL + " select * from weights",
    "forward_returns": f"with {MONTHLY_SQL}, {_FORWARD_SQL} select symbol, month, round(forward, 6) forward from forwards",
    "period_return_gross": _WEIGHTS_SQL + f", {_FORWARD_SQL} select signal, month, round(sum(weight * forward), 6) gross from weights join forwards using (symbol, month) where weight <> 0 group by all",
    "study_sharpe": _RETURNS_SQL + " select symbol, count(*) n, round(case when stddev_samp(r) > 0 then sqrt(12.0) * avg(r) / stddev_samp(r) end, 6) sharpe from rets group by symbol",
    "max_drawdown": _NAV_SQL + """, falls as (select *, nav / greatest(1.0, max(nav) over (partition by symbol order by month rows unbounded preceding)) - 1 fall from navs)
        select symbol, round(arg_max(nav, month) - 1, 6) total_return, round(min(fall), 6) max_drawdown from falls group by symbol""",
    "cumulative_nav": _NAV_SQL + " select symbol, month, round(nav, 6) nav from navs",
}

QUERIES = {
    "daily_returns": daily_returns, "monthly_ohlc": monthly_ohlc, "monthly_panel": monthly_panel, "month_gaps": month_gaps,
    "signal_momentum": _signals("momentum"), "signal_reversal": _signals("reversal"), "signal_trend": _signals("trend"), "signal_low_volatility": _signals("low_volatility"),
    "signal_low_downside": _signals("low_downside"), "signal_low_max_daily": _signals("low_max"), "long_short_weights": long_short_weights, "forward_returns": forward_returns,
    "period_return_gross": period_return_gross, "study_sharpe": study_sharpe, "max_drawdown": max_drawdown, "cumulative_nav": cumulative_nav,
    "period_return_net": period_return_net, "signal_cost_grid": signal_cost_grid,
}
