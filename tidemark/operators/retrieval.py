"""Lexical retrieval and its evaluation, grading, and small text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, MOST_HITS = 1.2, 0.75, 20


def terms(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def normalize(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of docs (doc_id, text)."""
    return docs.select("doc_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, cf, idf) over a corpus."""
    n = docs.count()
    by = term_counts(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return by.select("term", "df", "cf", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best of docs for each of queries (query_id, query), by BM25; ties by doc_id.

    Only postings of terms that some query has are kept: the terms of the queries are distinct and few, and joined without
    a hint, so a long list of queries is shuffled. Document lengths need no shuffle of their own; the corpus's size and mean
    length come to the driver.
    """
    if not 1 <= k <= MOST_HITS:
        raise ValueError(f"k must lie in 1..{MOST_HITS}")
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    split = docs.select("doc_id", terms(F.col("text")).alias("ts")).withColumn("len", F.size("ts"))
    n, mean_len = split.agg(F.count("*"), F.avg("len")).first()  # two numbers
    wanted = asked.select("term").distinct()
    postings = split.select("doc_id", "len", F.explode("ts").alias("term")).join(wanted, "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (mean_len or 1.0)))
    scores = postings.join(df, "term").withColumn("part", part).join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def retrieval_metrics(hits: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """One row: recall and reciprocal rank over queries with a relevant document, false positives and abstentions over the
    others, each null where there is no such query. judged has (query_id, doc_id, relevant)."""
    top = hits.filter(F.col("rank") <= k)
    per = judged.groupBy("query_id").agg(F.sum("relevant").alias("n_relevant"))
    got = top.join(judged.filter("relevant = 1"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"))
    any_hit = top.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    rows = per.join(got, "query_id", "left").join(any_hit, "query_id", "left")
    answerable = F.col("n_relevant") > 0
    hit = F.when(F.coalesce("n_hits", F.lit(0)) > 0, 1.0).otherwise(0.0)
    return rows.agg(
        F.count(F.when(answerable, 1)).alias("n_answerable"), F.avg(F.when(answerable, F.coalesce("found", F.lit(0)) / F.col("n_relevant"))).alias("recall"),
        F.avg(F.when(answerable, F.coalesce(1 / F.col("first"), F.lit(0.0)))).alias("mrr"), F.avg(F.when(~answerable, hit)).alias("false_positive"), F.avg(F.when(~answerable, 1 - hit)).alias("abstention"),
    )


def field_accuracy(expected: DataFrame, given: DataFrame, fields: list[str]) -> DataFrame:
    """(field, cases, matches, accuracy): a missing answer counts as wrong; null equals null."""
    e = expected.select("case_id", *[F.col(f).alias(f"e_{f}") for f in fields])
    g = given.select("case_id", *[F.col(f).alias(f"g_{f}") for f in fields], F.lit(True).alias("answered"))
    both = e.join(g, "case_id", "left")
    sums = both.agg(F.count("*").alias("cases"), *[F.sum((F.coalesce("answered", F.lit(False)) & F.col(f"e_{f}").eqNullSafe(F.col(f"g_{f}"))).cast("int")).alias(f) for f in fields])
    long = sums.selectExpr("cases", f"stack({len(fields)}, {', '.join(f"'{f}', `{f}`" for f in fields)}) as (field, matches)")
    return long.withColumn("accuracy", F.try_divide("matches", "cases"))


def dedupe_first_rank(rows: DataFrame, key: Column, rank: str) -> DataFrame:
    """The first row by rank of each key without regard to case, nulls left out."""
    best = rows.withColumn("_k", F.lower(key)).filter("_k is not null").groupBy("_k").agg(F.min_by(F.struct(*rows.columns), F.col(rank)).alias("r"))
    return best.select("r.*")


def find_notes(rows: DataFrame, text: str, needle: str, newest: str, n: int) -> DataFrame:
    """The n newest rows whose text holds the needle without regard to case."""
    return rows.filter(F.locate(needle.lower(), F.lower(F.col(text))) > 0).orderBy(F.desc(newest), F.desc(rows.columns[0])).limit(n)
