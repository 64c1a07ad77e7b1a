"""Problem 2: each event with the attributes of its entity that were known at the event's time.

Attributes and events of an entity are put in one order by time, attributes first; the best attribute so far is a
running maximum. Hot entities are cut by time; each shard gets the best attribute of all earlier shards as carry-in,
and the shards run independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import need
from tidemark.timeshard import SHARD, plan_shards


def as_known_at(events: DataFrame, attributes: DataFrame, keys: list[str], at: Column, known_at: Column, rank: list[Column], pick: str, target_rows: int | None = None) -> DataFrame:
    """Every column of each event row, as the struct `event`, with `known`, the struct (rank0.., pick) of the attribute row
    that ranks highest among those with the event's keys and known_at <= at.

    at and known_at are bigints of microseconds. rank orders attributes, the most important first, null lowest; of
    equal ones the smallest pick, a string, is taken (null only if nothing else is there). An event with a null key or null time,
    or one that nothing was known for, gets no row; an attribute with a null key or null known_at is never known.
    Repeated attributes change nothing; repeated events give repeated rows. Clashing column names do no harm: each side stays in its own struct.
    """
    need(events, *keys)
    need(attributes, *keys, pick)
    ranks = [f"rank{i}" for i in range(len(rank))]
    facts = attributes.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], known_at.alias("t"), *[r.alias(n) for r, n in zip(rank, ranks, strict=True)], F.col(f"`{pick}`").alias("pick"))
    asks = events.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], at.alias("t"), F.struct("*").alias("event"))
    own = [f"k{i}" for i in range(len(keys))]
    facts, asks = facts.dropna(subset=[*own, "t"]), asks.dropna(subset=[*own, "t"])
    plan = plan_shards(facts.select(*own, "t").unionByName(asks.select(*own, "t")), own, "t", target_rows)
    best = F.struct(*ranks, _turned(F.col("pick")).alias("pick"))
    facts = facts.select(*own, "t", F.lit(0).alias("late"), best.alias("known"))
    kind = facts.schema["known"].dataType
    asks = asks.select(*own, "t", F.lit(1).alias("late"), F.lit(None).cast(kind).alias("known"), "event")
    line = plan.assign(facts.unionByName(asks, allowMissingColumns=True))
    w = Window.partitionBy(*own, SHARD).orderBy("t", "late").rowsBetween(Window.unboundedPreceding, 0)
    running = F.max("known").over(w)
    if plan.hot:
        tops = plan.only_hot(plan.assign(facts)).groupBy(*own, SHARD).agg(F.max("known").alias("top"))
        line = line.join(F.broadcast(plan.carry_in(tops, F.max("top"))), [*own, SHARD], "left")
        running = F.greatest(running, "_carry0")
    found = line.withColumn("known", running).filter("late = 1 and known is not null")
    back = F.decode(F.unhex(F.translate(F.rtrim(F.col("known.pick"), F.lit("g")), UP, DOWN)), "utf-8")
    return found.select("event", F.struct(*[F.col(f"known.{r}") for r in ranks], back.alias("pick")).alias("known"))


UP, DOWN = "0123456789ABCDEF", "FEDCBA9876543210"


def _turned(text: Column) -> Column:
    """Text whose order is the reverse of the given text's order by bytes, so that the smallest is found by a maximum: the
    hexadecimal digits turned round, and an end that comes after every digit."""
    return F.concat(F.translate(F.hex(F.encode(text, "utf-8")), UP, DOWN), F.lit("g"))
