"""Lineage graphs, saved workflow state and budgets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ledger import running_totals
from tidemark.session import checkpoint

PARTS_AT_ONCE = 24
EDGE_FIELDS = {"sha256", "size_bytes", "media_type"}


def closure(edges: DataFrame, roots: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, depth) of all nodes reached from roots (node) over edges (src, dst), each at its least depth; cycles are fine.
    Each round joins only the nodes that are new and leaves out those known. What a round found is written once, as a part of
    its own; edges are written once before, as they may be dear to make."""
    edges = checkpoint(edges.select("src", "dst").filter("src is not null and dst is not null"))
    parts = [checkpoint(roots.select("node").distinct().withColumn("depth", F.lit(0)))]
    for depth in range(1, most_rounds + 1):
        frontier = parts[-1]
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        new = checkpoint(step.join(_union([p.select("node") for p in parts]), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return _union(parts)
        parts.append(new)
        if len(parts) > PARTS_AT_ONCE:  # a deep graph does not make an ever longer plan
            parts = [checkpoint(_union(parts[:-1])), new]
    raise RuntimeError("the graph is deeper than most_rounds")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def closure_violations(reached: DataFrame, references: DataFrame, objects: DataFrame) -> DataFrame:
    """(node, reason) of reached nodes: metadata_conflict where references (node, size_bytes, media_type) tell different things
    of one node, missing where objects (node, size_bytes) does not hold it, mismatch where its size there is another."""
    told = references.join(reached.select("node"), "node", "left_semi").groupBy("node").agg(F.count_distinct(F.struct("size_bytes", "media_type")).alias("n"), F.min("size_bytes").alias("told"))
    both = reached.select("node").join(told, "node", "left").join(objects.groupBy("node").agg(F.min("size_bytes").alias("size")), "node", "left")
    checks = {"metadata_conflict": F.col("n") > 1, "missing": F.col("size").isNull(), "mismatch": (F.col("n") == 1) & (F.col("size") != F.col("told"))}
    return both.select("node", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in checks.items()]))).alias("reason"))


def containing(members: DataFrame, artifact: str, n: int = 100) -> DataFrame:
    """The first n roots of members (root, artifact) that contain the artifact, in order."""
    return members.filter(F.col("artifact") == artifact).select("root").distinct().orderBy("root").limit(n)


def trajectories(operations: DataFrame, attempts: DataFrame) -> DataFrame:
    """operations (operation_id, kind) with their attempts (operation_id, attempt_no, outcome) nested in order, and status:
    missing without any attempt, pending while the last has no outcome, else that outcome."""
    nested = attempts.groupBy("operation_id").agg(F.array_sort(F.collect_list(F.struct("attempt_no", "outcome"))).alias("attempts"))
    out = operations.join(nested, "operation_id", "left")
    last = F.try_element_at("attempts", F.lit(-1))["outcome"]
    return out.withColumn("status", F.when(F.col("attempts").isNull(), "missing").otherwise(F.coalesce(last, F.lit("pending"))))


def _edges_of(value: object, path: str) -> Iterator[tuple[str, str, str, int, str]]:
    if isinstance(value, dict):
        if value.keys() == EDGE_FIELDS:
            yield path, str(value["sha256"]), str(value["media_type"]), int(value["size_bytes"]), "ref"
            return
        for key, inner in value.items():
            yield from _edges_of(inner, f"{path}/{key.replace('~', '~0').replace('/', '~1')}")
    elif isinstance(value, list):
        for i, inner in enumerate(value):
            yield from _edges_of(inner, f"{path}/{i}")


def extract_edges(docs: DataFrame) -> DataFrame:
    """(doc_id, path, sha256, media_type, size_bytes) of every reference within docs (doc_id, body), path as JSON pointer;
    a body that is no JSON has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, body in zip(pdf["doc_id"], pdf["body"], strict=True):
                try:
                    out += [(doc_id, *e[:4]) for e in _edges_of(json.loads(body), "")]
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(out, columns=["doc_id", "path", "sha256", "media_type", "size_bytes"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "body").mapInPandas(run, "doc_id string, path string, sha256 string, media_type string, size_bytes bigint")


def overlap(train: DataFrame, held_out: DataFrame, columns: list[str]) -> DataFrame:
    """What both sides share in any of the columns: (column, value)."""
    parts = [train.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).intersect(held_out.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preference_pairs(answers: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected): of each prompt the best and the worst answer, if they differ; not all pairs. answers has
    (prompt, answer, score); ties by answer."""
    by = answers.groupBy("prompt").agg(F.max(F.struct("score", "answer")).alias("a"), F.min(F.struct("score", "answer")).alias("b"))
    return by.filter("a.answer <> b.answer and a.score > b.score").select("prompt", F.col("a.answer").alias("chosen"), F.col("b.answer").alias("rejected"))


def idempotent_insert(table: DataFrame, new: DataFrame, key: str, body: str) -> DataFrame:
    """(key, outcome) for each key of new: inserted, unchanged if the table holds the same body, conflict if another. Of
    several new rows of one key the smallest body counts."""
    one = new.groupBy(key).agg(F.min(body).alias("new_body"))
    old = table.groupBy(key).agg(F.min(body).alias("old_body"), F.lit(True).alias("there"))
    outcome = F.when(F.col("there").isNull(), "inserted").when(F.col("old_body").eqNullSafe(F.col("new_body")), "unchanged").otherwise("conflict")
    return one.join(old, key, "left").select(key, outcome.alias("outcome"))


def budget_commitments(events: DataFrame, cap: float, target_rows: int | None = None) -> DataFrame:
    """events (account, seq, at, reserved, actual) with the running commitment, an actual charge in place of its
    reservation where it is known, whether it is over the cap, and whether the clock went back."""
    rows = events.withColumn("charge", F.coalesce("actual", "reserved"))
    out = running_totals(rows, "account", F.col("seq"), ["at"], {"committed": "charge"}, {"latest": "at"}, target_rows)
    return out.withColumn("over_cap", F.col("committed") > cap).withColumn("clock_back", F.coalesce(F.col("at") < F.col("latest"), F.lit(False))).drop("latest", "charge")


def owned_or_shared(rows: DataFrame, key: str, value: str, owner: str) -> DataFrame:
    """The row of rows (owner, shared, ..) with that key that the owner has, the unshared first, else one that is shared; at
    most one."""
    mine = rows.filter((F.col(key) == value) & ((F.col("owner") == owner) | F.col("shared")))
    return mine.orderBy((F.col("owner") == owner).desc_nulls_last(), "owner", "shared").limit(1)


def recovery_queue(runs: DataFrame, n: int) -> DataFrame:
    """The n runs (run_id, status, last_recovery_at, created_at) waiting longest for recovery: never tried first, then oldest."""
    return runs.filter("status = 'RECEIVED'").orderBy(F.col("last_recovery_at").asc_nulls_first(), "created_at", "run_id").limit(n)


def event_histories(events: DataFrame) -> DataFrame:
    """(run_id, states, contiguous): the states of each run in order of version, and whether the versions are 1, 2, 3 .."""
    by = events.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("version", "state"))).alias("e"))
    versions = F.transform("e", lambda x: x["version"].cast("bigint"))
    return by.select("run_id", F.transform("e", lambda x: x["state"]).alias("states"), (versions == F.sequence(F.lit(1).cast("bigint"), F.size("e").cast("bigint"))).alias("contiguous"))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows offset.. of an order that leaves no ties; at most 100 of them."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must lie in 1..100, offset not below 0")
    return rows.orderBy(*order).offset(offset).limit(limit)


def outcomes(candidates: DataFrame, results: DataFrame, stopped: DataFrame) -> DataFrame:
    """candidates (candidate_id, ready) with status: budget_stopped if in stopped (candidate_id), skipped if not ready, failed if
    its result (candidate_id, nav) is missing or has no value, else completed."""
    out = candidates.join(results.select("candidate_id", "nav"), "candidate_id", "left").join(stopped.select("candidate_id", F.lit(True).alias("_s")), "candidate_id", "left")
    status = F.when(F.col("_s"), "budget_stopped").when(~F.col("ready"), "skipped").when(F.col("nav").isNull(), "failed").otherwise("completed")
    return out.withColumn("status", status).drop("_s")


def report(candidates: DataFrame, results: DataFrame, reviews: DataFrame, checks: DataFrame) -> DataFrame:
    """One row for each candidate (candidate_id, source) with its result (candidate_id, status, nav), review (candidate_id,
    direction_agrees) and validation (candidate_id, reason), and what they come to: unavailable without a result, failed if it was
    not completed, contested if the review disagrees, unvalidated with a reason or without validation, else supported."""
    out = candidates
    for side in (results, reviews, checks):
        out = out.join(side, "candidate_id", "left")
    checked = checks.select("candidate_id", F.lit(True).alias("_checked"))
    out = out.join(checked, "candidate_id", "left")
    verdict = (
        F.when(F.col("status").isNull(), "unavailable").when(F.col("status") != "completed", "failed").when(~F.col("direction_agrees"), "contested")
        .when(F.col("_checked").isNull() | F.col("reason").isNotNull(), "unvalidated").otherwise("supported")
    )
    return out.withColumn("verdict", verdict).drop("_checked")
