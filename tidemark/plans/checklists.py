"""Queries of checklists, containment, completeness and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import funding, grading
from tidemark.plans.selection import _accounts
from tidemark.plans.study import rounded
from tidemark.plans.views import NATION_SQL, PANEL_SQL, nation_panel, segment_panel
from tidemark.sources.artifacts import permitted
from tidemark.tables import load


def source_checklist(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    checks = {"no_text": F.col("text").isNull() | (F.col("text") == ""), "no_language": F.col("lang").isNull(), "no_security": F.col("security_id").isNull(), "unknown_time": F.col("available_at").isNull(), "too_long": F.coalesce("n_chars", F.lit(0)) > 5000}
    return grading.reasons(docs, checks).select("doc_id", "reasons", "accepted")


def quote_containment(spark: SparkSession, d: str) -> DataFrame:
    """Whether each paper's text holds its whole title as a quote, and all of the title's words."""
    title = F.lower(F.coalesce("title", F.lit("?")))
    papers = load(spark, d, "corpus").select("paper_id", F.lower("text").alias("text"), F.concat(F.array(title), F.split(title, " ")).alias("words"))
    return grading.supported(papers, "text", "words").select("paper_id", "supported").distinct()


def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Supplier and part of each returned line, where no kept line has the same."""
    li = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("item_id"), F.col("l_partkey").alias("field"), "l_returnflag")
    return grading.uncovered(li.filter("l_returnflag = 'R'"), li.filter("l_returnflag = 'N'"))


def judgment_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Customers' nations against the market segments that their customers are in, as documents."""
    judged = load(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("query_id"), F.concat_ws(":", "c_mktsegment", F.pmod("c_custkey", F.lit(4))).alias("doc_id"))
    return grading.judgment_gaps(judged, 20)


def series_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Days on which only one of a nation and a segment was traded."""
    one = nation_panel(spark, d).filter("symbol = 'N03'")
    return grading.aligned(one, segment_panel(spark, d).filter("symbol = 'BUILDING'"), ["date"])


def direction_amendments(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    side = lambda c: F.when(c, "high_long").otherwise("low_long")
    rows = o.select(
        F.col("o_orderkey").alias("case_id"), side(F.col("o_totalprice") > 200_000).alias("claim"), F.when(F.col("o_orderstatus") != "P", side(F.col("o_orderkey") % 3 == 0)).alias("review"),
        F.when(F.col("o_orderpriority") != "5-LOW", side(F.col("o_orderkey") % 2 == 0)).alias("revision"), (F.col("o_custkey") % 10 == 0).alias("held"),
    )
    return grading.amended(rows).select("case_id", "direction", "reason")


def solvency_guard(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose balance does not pay for a thousandth of what they sold less what came back, the other way round."""
    accounts = _accounts(spark, d).select("account", (F.col("cash") / 1000).alias("cash"), (-F.col("notional") / 1000).alias("notional"))
    return rounded(funding.collateral(accounts).filter("nav <= 0").select("account", "nav"), "nav", places=2)


def permitted_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents by kind of content as rights, which end when the document became known."""
    docs = load(spark, d, "documents").select("doc_id", F.array("content_kind", "lang").alias("permitted_uses"), F.col("available_at").alias("expires_at"))
    return permitted(docs, "research_note", F.lit("2022-01-01 00:00:00").cast("timestamp_ntz")).select("doc_id", "expires_at")


SQL = {
    "source_checklist": """with c as (select doc_id, list_filter([case when text is null or text = '' then 'no_text' end, case when lang is null then 'no_language' end, case when security_id is null then 'no_security' end,
        case when available_at is null then 'unknown_time' end, case when coalesce(n_chars, 0) > 5000 then 'too_long' end], lambda x: x is not null) r from documents) select doc_id, coalesce(array_to_string(r, ','), '') reasons, len(r) = 0 accepted from c""",
    "quote_containment": """with p as (select paper_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') t, list_transform(list_prepend(lower(coalesce(title, '?')), string_split(lower(coalesce(title, '?')), ' ')), lambda w: trim(regexp_replace(w, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')) w from corpus)
        select distinct paper_id, coalesce(list_bool_and(list_transform(w, lambda x: contains(t, x))), false) supported from p""",
    "evidence_coverage": "select distinct l_suppkey item_id, l_partkey field from lineitem a where l_returnflag = 'R' and not exists (select 1 from lineitem b where b.l_suppkey = a.l_suppkey and b.l_partkey = a.l_partkey and b.l_returnflag = 'N')",
    "judgment_gaps": "select c_nationkey query_id, 20 - count(distinct c_mktsegment || ':' || (c_custkey % 4)) n_missing from customer where c_acctbal > 5000 group by 1 having n_missing > 0",
    "series_alignment": f"""with {NATION_SQL}, a as (select date from panel where symbol = 'N03'), {PANEL_SQL.replace('panel as', 'seg as')}, b as (select date from seg where symbol = 'BUILDING')
        select date, 'left' side from a where date not in (select date from b) union all select date, 'right' from b where date not in (select date from a)""",
    "direction_amendments": """with s as (select o_orderkey k, case when o_totalprice > 200000 then 'high_long' else 'low_long' end claim, case when o_orderstatus <> 'P' then case when o_orderkey % 3 = 0 then 'high_long' else 'low_long' end end review,
        case when o_orderpriority <> '5-LOW' then case when o_orderkey % 2 = 0 then 'high_long' else 'low_long' end end rev, o_custkey % 10 = 0 held from orders),
        w as (select *, case when held then 'compilation_held' when rev is null then 'revision_missing' when review is null or review <> rev then 'direction_not_confirmed' when rev = claim then 'unchanged' end reason from s)
        select k case_id, case when reason is null then rev else claim end direction, reason from w""",
    "solvency_guard": """with a as (select l_suppkey account, max(s_acctbal) - sum(case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end) / 1000 nav from lineitem join supplier on l_suppkey = s_suppkey group by 1) select account, round(nav, 2) nav from a where nav <= 0""",
    "permitted_sources": "select doc_id, available_at expires_at from documents where (content_kind = 'research_note' or lang = 'research_note') and (available_at is null or timestamp '2022-01-01' < available_at)",
}

QUERIES = {q.__name__: q for q in (source_checklist, quote_containment, evidence_coverage, judgment_gaps, series_alignment, direction_amendments, solvency_guard, permitted_sources)}
