"""Quote events: identity and routing, admission, and durable dedupe of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.deliveries import Conflict, SeenLedger, message_key, message_keys

MOST_BYTES = 16_384


def identify(quotes: DataFrame, source: str) -> DataFrame:
    """quotes with event_id, the digest of source and quote, and route, which keeps a security's events in order."""
    return quotes.withColumn("event_id", F.sha2(F.concat_ws(":", F.lit(source), "source_id"), 256)).withColumn("route", F.concat_ws(":", F.lit(source), "security_id"))


def first_payloads(deliveries: DataFrame) -> DataFrame:
    """The first delivery of each event, by received_at, then delivery_id."""
    rows = deliveries.withColumn("key", message_key("event_id", "payload")).filter("key is not null")
    first = rows.groupBy("key").agg(F.min(F.struct("received_at", "delivery_id")).alias("f"))
    return first.select(F.col("key").alias("event_id"), "f.delivery_id", "f.received_at")


def payload_conflicts(deliveries: DataFrame) -> DataFrame:
    """Events that were delivered with payloads of different bytes."""
    rows = deliveries.withColumn("key", message_key("event_id", "payload")).filter("key is not null")
    by = rows.groupBy("key").agg(F.count_distinct("payload").alias("n_payloads"), F.count("*").alias("n_deliveries"))
    return by.filter("n_payloads > 1").withColumnRenamed("key", "event_id")


def admit(events: DataFrame, inventory: DataFrame) -> DataFrame:
    """events with `admitted`: known to the inventory (event_id, sha256) by id and bytes, and not too large. A stream may be
    joined with a fixed inventory."""
    known = inventory.select(F.col("event_id").alias("_id"), F.col("sha256").alias("_sha"))
    joined = events.join(known, events["event_id"] == known["_id"], "left")
    ok = F.col("_sha").eqNullSafe(F.sha2(F.encode("payload", "utf-8"), 256)) & (F.octet_length("payload") <= MOST_BYTES)
    return joined.withColumn("admitted", F.coalesce(ok, F.lit(False))).drop("_id", "_sha")


def dedupe_stream(deliveries: DataFrame, ledger: SeenLedger, sink: str, progress: str, name: str = "deliveries", conflicts: str = "raise", after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Runs a stream of deliveries until what is there has been read: each micro-batch is admitted by the ledger, whose state
    never expires, and (key, delivery_id) of what it kept is written to sink/batch=N, nothing else: what comes again later
    is not written again.

    A batch that is run again after a failure finds its own admission in the ledger by its name and number, so it
    overwrites its output with the same rows. A known event with another payload is no repeat: with conflicts="raise" the
    stream fails with Conflict, after what the batch kept was written; with "keep" such deliveries go to sink-conflicts.
    """
    if conflicts not in ("raise", "keep"):
        raise ValueError("conflicts must be raise or keep")

    def one(batch: DataFrame, number: int) -> None:
        came = ledger.admit(message_keys(batch, "delivery_id", "received_at", "event_id", "payload"), f"{name}:{number}")
        came.admitted.select("key", "delivery_id").write.mode("overwrite").parquet(f"{sink}/batch={number}")
        differing = came.repeats.filter("kind = 'differs'")
        if conflicts == "keep":
            differing.select("key", "delivery_id", "kept_id").write.mode("overwrite").parquet(f"{sink}-conflicts/batch={number}")
        elif not differing.isEmpty():
            raise Conflict(f"batch {number} holds a known event with another payload")
        if after:
            after(batch, number)

    return deliveries.writeStream.foreachBatch(one).option("checkpointLocation", progress).trigger(availableNow=True).start()
