"""What leaves for, or comes from, other systems, as tables: keyed upserts, graphs and metrics with readback, traces, queues,
saved answers, pinned files and message streams. The services themselves are not contacted here."""

from __future__ import annotations

import hashlib
import shutil
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.documents import strict_json

RUNS = "run_id string, owner string, status string, request_sha256 string, state_version int, created_at timestamp, last_recovery_at timestamp"
RUN_EVENTS = "run_id string, version int, state string, at timestamp, detail string"
BUDGETS = "run_id string, started_at timestamp, deadline timestamp, max_cost_microusd bigint, operations string"
WORKFLOWS = "workflow_id string, owner string, brief string, budget_run_id string, status string, created_at timestamp"
DATASET_VERSIONS = "dataset_id string, version_sha256 string, owner string, shared boolean, permitted_uses array<string>, expires_at timestamp, manifest string"


def content_id(*columns: str) -> Column:
    """The digest of a row's columns as JSON, in the given order: equal content has one identity."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table after new rows were put in under their key: a new row takes the place of the old one of its key. Of several
    new rows of a key the one with the smallest content is taken, so that the result does not depend on their order."""
    columns = [c for c in table.columns if c != key]
    one = new.groupBy(key).agg(F.min(F.struct(*columns)).alias("r")).select(key, "r.*")
    return table.join(one.select(key), key, "left_anti").unionByName(one.select(*table.columns))


def publish_versions(catalog: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts) for new dataset versions (dataset_id, version_sha256, body): a version that is there with the
    same body is left alone, one with another body is a conflict."""
    one = new.groupBy("dataset_id", "version_sha256").agg(F.min("body").alias("body"), F.count_distinct("body").alias("n"))
    old = catalog.groupBy("dataset_id", "version_sha256").agg(F.min("body").alias("_old"), F.lit(True).alias("_there"))
    both = one.join(old, ["dataset_id", "version_sha256"], "left")
    clash = (F.col("n") > 1) | (F.col("_there") & ~F.col("_old").eqNullSafe(F.col("body")))
    wrong = F.coalesce(clash, F.lit(False))
    return both.filter(F.col("_there").isNull() & ~wrong).select("dataset_id", "version_sha256", "body"), both.filter(wrong).select("dataset_id", "version_sha256")


def graph_tables(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, kind), edges (src, dst, path)) to be merged into a graph, each once, of edges (src, dst, path, media_type)."""
    nodes = edges.select(F.col("src").alias("node"), F.lit("document").alias("kind")).unionByName(edges.select(F.col("dst").alias("node"), F.col("media_type").alias("kind")))
    return nodes.groupBy("node").agg(F.min("kind").alias("kind")), edges.select("src", "dst", "path").distinct()


def readback(sent: DataFrame, found: DataFrame) -> DataFrame:
    """What was sent and is not found again, and what is found and was not sent: the rows with `side`, repeated rows counted."""
    found = found.select(*sent.columns)
    return sent.exceptAll(found).withColumn("side", F.lit("not_found")).unionByName(found.exceptAll(sent).withColumn("side", F.lit("not_sent")))


def metric_rows(results: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(run, metric, value) for a metric store, one row for each finite value of each of the columns."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    rows = results.select(F.col(key).cast("string").alias("run"), F.explode(entries).alias("e")).select("run", "e.*")
    return rows.filter("value is not null and not isnan(value) and abs(value) < double('Infinity')")


def gauges(rows: DataFrame, label: str, prefix: str) -> DataFrame:
    """(name, label, value): how many rows each label has, and one total, as gauges of a metrics page."""
    by = rows.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("unknown")).alias("label")).agg(F.count("*").cast("double").alias("value"))
    total = by.agg(F.sum("value").alias("value")).select(F.lit(f"{prefix}_total").alias("name"), F.lit("").alias("label"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return by.select(F.lit(f"{prefix}_count").alias("name"), "label", "value").unionByName(total)


def trace_runs(operations: DataFrame) -> DataFrame:
    """(trace_id, run_id, parent_id, kind, started_at, ended_at) of operations (trace_id, operation_id, kind, started_at, ended_at): a
    root for each trace from its first start to its last end (null while one is open), and a child for each operation."""
    roots = operations.groupBy("trace_id").agg(F.min("started_at").alias("started_at"), F.when(F.count("*") == F.count("ended_at"), F.max("ended_at")).alias("ended_at"))
    root = roots.select("trace_id", F.concat(F.lit("root:"), F.col("trace_id").cast("string")).alias("run_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("kind"), "started_at", "ended_at")
    child = operations.select("trace_id", F.col("operation_id").cast("string").alias("run_id"), F.concat(F.lit("root:"), F.col("trace_id").cast("string")).alias("parent_id"), "kind", "started_at", "ended_at")
    return root.unionByName(child)


def span_lines(spans: DataFrame) -> DataFrame:
    """(value): one line of JSON for each span (trace_id, span_id, name, started_at, ended_at), context nested, as a trace file has."""
    context = F.struct("trace_id", "span_id")
    return spans.select(F.to_json(F.struct(context.alias("context"), "name", F.col("started_at").alias("start_time"), F.col("ended_at").alias("end_time"))).alias("value"))


def next_jobs(jobs: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """(group_id, job_id): of each group of jobs (group_id, job_id, dedupe_id, sent_at) the first that was not acknowledged (job_id), a
    job sent again under its dedupe_id being the first one sent."""
    one = jobs.groupBy("dedupe_id").agg(F.min(F.struct("sent_at", "job_id", "group_id")).alias("j")).select("j.*")
    return one.join(acknowledged.select("job_id"), "job_id", "left_anti").groupBy("group_id").agg(F.min(F.struct("sent_at", "job_id")).alias("j")).select("group_id", "j.job_id")


def fresh(entries: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Saved entries (.., retrieved_at) no older than so many hours and not from the future."""
    return entries.filter(F.col("retrieved_at").between(now - F.expr(f"interval {hours} hours"), now))


def discovery_hits(answers: DataFrame) -> DataFrame:
    """(answer_id, rank, doi, title) of saved search answers (answer_id, body), as found in message.items, first of each DOI without
    regard to case; a body that is no JSON, or has no items, gives none."""
    items = F.try_variant_get(F.try_parse_json("body"), "$.message.items", "array<struct<DOI:string,title:array<string>>>")
    rows = answers.select("answer_id", F.posexplode(items).alias("rank", "i")).select("answer_id", (F.col("rank") + 1).alias("rank"), F.col("i.DOI").alias("doi"), F.get("i.title", F.lit(0)).alias("title"))
    best = rows.filter("doi is not null").groupBy("answer_id", F.lower("doi").alias("_k")).agg(F.min(F.struct("rank", "doi", "title")).alias("r"))
    return best.select("answer_id", "r.*")


def json_column(rows: DataFrame, body: str, most_bytes: int = 32_768) -> DataFrame:
    """rows with json_reason, null where the text is JSON without repeated members, numbers that are not finite, or more than 16
    levels, and within the size; else repeated member, not finite, depth, size or syntax. Null texts are missing."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, json_reason string"

    def reason(text: object) -> str | None:
        if text is None:
            return "missing"
        try:
            strict_json(text, most_bytes)
        except ValueError as e:
            return str(e) if str(e) in ("repeated member", "not finite", "depth", "size") else "syntax"
        except RecursionError:
            return "depth"
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(json_reason=[reason(t) for t in pdf[body]])

    return rows.mapInPandas(run, schema)


def pinned_parquet(spark: SparkSession, path: str, sha256: str, folder: str) -> DataFrame:
    """A single Parquet file that must have the given digest: it is copied below the shared folder and the copy, not the file, is
    verified and read, so that what is read is what was verified."""
    copy = Path(folder, f"{sha256}.parquet")
    copy.parent.mkdir(parents=True, exist_ok=True)
    shutil.copyfile(path, copy)
    digest = hashlib.sha256()
    with copy.open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    if digest.hexdigest() != sha256:
        copy.unlink()
        raise ValueError("the file does not have its digest")
    return spark.read.parquet(str(copy))


def kafka_source(spark: SparkSession, servers: str, topic: str, most_per_batch: int) -> DataFrame:
    """A bounded stream of messages (event_id, payload, log_partition, log_offset, received_at) of a topic; needs Spark's Kafka
    package. Offsets are committed by the query's checkpoint, after its sink."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": most_per_batch}).load()
    return raw.select(F.col("key").cast("string").alias("event_id"), F.col("value").cast("string").alias("payload"), F.col("partition").alias("log_partition"), F.col("offset").alias("log_offset"), F.col("timestamp").alias("received_at"))


def kafka_sink(events: DataFrame, servers: str, topic: str) -> None:
    """Writes events (route, payload) keyed by route, acknowledged by all replicas; needs Spark's Kafka package."""
    events.select(F.col("route").alias("key"), F.col("payload").alias("value")).write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all"}).save()


def bounded_production(events: DataFrame, most: int) -> DataFrame:
    """The first `most` events (observed_at, security_id, source_id, ..) in the order in which they are to be sent."""
    return events.orderBy("observed_at", "security_id", "source_id").limit(most)
