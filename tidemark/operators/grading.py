"""Checklists, containment of quotes, completeness and alignment checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.retrieval import normalize


def reasons(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with the list of the names of the checks that hold, in their order, and whether none does."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()]))
    return rows.withColumn("reasons", F.concat_ws(",", found)).withColumn("accepted", F.size(found) == 0)


def supported(rows: DataFrame, text: str, anchors: str) -> DataFrame:
    """rows with whether the text, white space made even, holds every anchor of the array; a null side does not."""
    body = normalize(F.col(text))
    return rows.withColumn("supported", F.coalesce(F.forall(anchors, lambda a: F.contains(body, normalize(a))), F.lit(False)))


def uncovered(asserted: DataFrame, evidence: DataFrame) -> DataFrame:
    """(item_id, field) asserted without evidence for that item and field."""
    return asserted.select("item_id", "field").distinct().join(evidence.select("item_id", "field").distinct(), ["item_id", "field"], "left_anti")


def judgment_gaps(judged: DataFrame, n_documents: int) -> DataFrame:
    """(query_id, n_missing) of queries for which not every document is judged; counts, never the pairs."""
    by = judged.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n"))
    return by.filter(F.col("n") < n_documents).select("query_id", (F.lit(n_documents) - F.col("n")).alias("n_missing"))


def aligned(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two series has, with the side that has them."""
    a, b = left.select(*keys).distinct().withColumn("_a", F.lit(True)), right.select(*keys).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, keys, "full")
    return both.filter("_a is null or _b is null").select(*keys, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))


def amended(rows: DataFrame) -> DataFrame:
    """Of (claim, review, revision, held): the direction after review, and why it stayed if it did."""
    why = (
        F.when(F.col("held"), "compilation_held").when(F.col("revision").isNull(), "revision_missing").when(F.col("review").isNull() | (F.col("review") != F.col("revision")), "direction_not_confirmed")
        .when(F.col("revision") == F.col("claim"), "unchanged")
    )
    return rows.withColumn("reason", why).withColumn("direction", F.when(why.isNull(), F.col("revision")).otherwise(F.col("claim")))


def judgment_coverage(queries: DataFrame, documents: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, n_missing, n_foreign, n_repeated) of queries whose judgments (query_id, doc_id) are not one for each document:
    documents without any, judgments of documents that are not in the collection, and judgments given again. Counts only."""
    n = documents.select("doc_id").distinct().count()
    marked = judged.join(documents.select("doc_id").distinct().withColumn("_in", F.lit(True)), "doc_id", "left")
    by = marked.groupBy("query_id").agg(
        F.count_distinct(F.when(F.col("_in"), F.col("doc_id"))).alias("have"), F.count_distinct(F.when(F.col("_in").isNull(), F.col("doc_id"))).alias("n_foreign"), (F.count("*") - F.count_distinct("doc_id")).alias("n_repeated"),
    )
    out = queries.select("query_id").distinct().join(by, "query_id", "left").na.fill(0)
    return out.select("query_id", (F.lit(n) - F.col("have")).alias("n_missing"), "n_foreign", "n_repeated").filter("n_missing > 0 or n_foreign > 0 or n_repeated > 0")


def selected_sources(hits: DataFrame, packets: DataFrame, most_hits: int = 20, most_sources: int = 3) -> DataFrame:
    """(query_id, position, doc_id, packet_id): of the best most_hits of hits (query_id, rank, doc_id) the first most_sources that
    have a packet (doc_id, packet_id), in order of rank."""
    one = packets.groupBy("doc_id").agg(F.min("packet_id").alias("packet_id"))
    w = Window.partitionBy("query_id").orderBy("rank")
    found = hits.filter(F.col("rank") <= most_hits).join(one, "doc_id").withColumn("position", F.row_number().over(w))
    return found.filter(F.col("position") <= most_sources).select("query_id", "position", "doc_id", "packet_id")


def direction_grades(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """(case_id, correct, supported, passed) of cases (case_id, source, expected, anchors) and reviews (case_id, status, direction,
    quote, page). Where no direction is expected only an uncertain review without quote and page is right. Else a supported
    review must give it and quote page 1 of the source, white space made even, with every anchor in the quote."""
    both = cases.join(reviews, "case_id", "left")
    uncertain = F.col("expected").isNull() & (F.col("status") == "uncertain") & F.col("direction").isNull()
    quoted = (F.col("page") == 1) & F.contains(normalize(F.col("source")), F.col("quote")) & F.forall("anchors", lambda a: F.contains(F.col("quote"), normalize(a)))
    correct = F.when(F.col("expected").isNull(), uncertain).otherwise((F.col("status") == "supported") & (F.col("direction") == F.col("expected")))
    supported = F.when(F.col("expected").isNull(), uncertain & F.col("quote").isNull() & F.col("page").isNull()).otherwise((F.col("status") == "supported") & quoted)
    out = both.select("case_id", F.coalesce(correct, F.lit(False)).alias("correct"), F.coalesce(supported, F.lit(False)).alias("supported"))
    return out.withColumn("passed", F.col("correct") & F.col("supported"))


def batch_evaluation(cases: DataFrame, submissions: DataFrame) -> DataFrame:
    """(case_id, evidence, passed) of cases (case_id, request) and submissions (case_id, request, checks map): missing without a
    submission, invalid if it answers another request or has no checks, else verified and passed if every check holds."""
    both = cases.join(submissions.select("case_id", F.col("request").alias("_request"), "checks", F.lit(True).alias("_there")), "case_id", "left")
    invalid = ~F.col("_request").eqNullSafe(F.col("request")) | (F.coalesce(F.size(F.map_keys("checks")), F.lit(0)) <= 0)
    evidence = F.when(F.col("_there").isNull(), "missing").when(invalid, "invalid").otherwise("verified")
    return both.select("case_id", evidence.alias("evidence"), ((evidence == "verified") & F.coalesce(F.forall(F.map_values("checks"), lambda c: F.coalesce(c, F.lit(False))), F.lit(False))).alias("passed"))


def candidate_status(sources: DataFrame, bindings: DataFrame, observations: DataFrame) -> DataFrame:
    """sources (position, source_id, packet) with status: unbound without a reviewed binding (source_id, packet) of exactly that
    packet, source_unavailable without an observation (source_id, reviewed), needs_review if it is not reviewed, else compiled."""
    bound = bindings.select("source_id", "packet", F.lit(True).alias("_b")).distinct()
    seen = observations.groupBy("source_id").agg(F.bool_and(F.coalesce("reviewed", F.lit(False))).alias("_r"))
    out = sources.join(bound, ["source_id", "packet"], "left").join(seen, "source_id", "left")
    status = F.when(F.col("_b").isNull(), "unbound").when(F.col("_r").isNull(), "source_unavailable").when(~F.col("_r"), "needs_review").otherwise("compiled")
    return out.select("position", "source_id", "packet", status.alias("status"))


def weight_violations(allocations: DataFrame) -> DataFrame:
    """(synthesis_id, reason) of allocations (synthesis_id, source_id, numerator, denominator): not_positive, source_twice, and
    not_one where the weights do not add up to one, in whole numbers over the product of the distinct denominators."""
    by = allocations.groupBy("synthesis_id").agg(
        F.bool_or((F.col("numerator") <= 0) | (F.col("denominator") <= 0)).alias("bad"), (F.count("*") > F.count_distinct("source_id")).alias("twice"),
        F.collect_list(F.struct(F.col("numerator").cast("decimal(19,0)").alias("n"), F.col("denominator").cast("decimal(19,0)").alias("d"))).alias("w"), F.collect_set(F.col("denominator").cast("decimal(19,0)")).alias("ds"),
    )
    whole = F.aggregate("ds", F.lit(1).cast("decimal(38,0)"), lambda a, d: (a * d).cast("decimal(38,0)"))
    total = F.aggregate("w", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x["n"] * F.round(F.col("whole") / x["d"], 0)).cast("decimal(38,0)"))
    rows = by.withColumn("whole", whole).withColumn("total", F.when(~F.col("bad"), total))
    found = F.array_compact(F.array(F.when(F.col("bad"), F.lit("not_positive")), F.when(F.col("twice"), F.lit("source_twice")), F.when(F.col("total") != F.col("whole"), F.lit("not_one"))))
    return rows.select("synthesis_id", F.explode(found).alias("reason"))


def conjoined(rows: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """(key, passed, failed): whether all of a row's boolean columns hold, null not, and the names of those that do not."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(c)) for c in checks]))
    return rows.select(key, (F.size(failed) == 0).alias("passed"), F.concat_ws(",", failed).alias("failed"))


def metadata_matches(papers: DataFrame, word: str, identifier: str, n: int) -> DataFrame:
    """(doc_id, exact): the first n of papers (doc_id, title, identifier) whose title holds the word, or whose identifier is the one
    asked for, without regard to case; that one first, then by doc_id."""
    exact = F.coalesce(F.lower("identifier") == identifier.lower(), F.lit(False))
    held = F.coalesce(F.array_contains(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), word.lower()), F.lit(False))
    found = papers.filter(exact | held).select("doc_id", exact.alias("exact")).groupBy("doc_id").agg(F.max("exact").alias("exact"))
    return found.orderBy(F.desc("exact"), "doc_id").limit(n)
