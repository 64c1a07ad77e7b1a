"""Problem 1: overlapping and gapped intervals as continuous periods and the gaps between them.

A mergeable aggregate holds a sorted list of disjoint closed intervals. Map side, every batch of rows is folded into one
list for each key (and time shard) in it; only lists are shuffled. A key's lists are then merged two by two, each pair by one
linear merge, in a tree whose root is the key's list of periods; its complement are the gaps. Above that, the shards of
a hot key are ordered by start, so merging two neighbours only compares the furthest end of the one with the first
intervals of the other, and what travels further up the tree is one end for each shard, never the lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.groups import starts_of, whole_groups
from tidemark.tables import micros, need
from tidemark.timeshard import SHARD, ShardPlan, plan_shards


def merge_lists(owner: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed intervals, each owner's a run of sorted lists, as one sorted disjoint list for each owner (owners ascending).
    Instants are compared by rank among all that occur, so that owner and instant make one number; the sort that merges
    numbers finds the sorted runs and merges them in linear time."""
    if not len(starts):
        return owner, starts, ends
    instants, ranks = np.unique(np.concatenate((starts, ends)), return_inverse=True)
    own = owner.astype(np.int64) * len(instants)
    first, last = own + ranks[: len(starts)], own + ranks[len(starts) :]
    order = np.argsort(first, kind="stable")
    first, last, owner = first[order], np.maximum.accumulate(last[order]), owner[order]
    begins = np.append(True, (first[1:] > last[:-1]) | (owner[1:] != owner[:-1]))
    at = np.flatnonzero(begins)
    closing = np.append(at[1:] - 1, len(first) - 1)
    own = owner[at].astype(np.int64) * len(instants)
    return owner[at], instants[first[at] - own], instants[last[closing] - own]


def _lists(keys: pa.Table, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row (key, shard, starts, ends) for each owner, of which keys has one row."""
    offsets = pa.array(np.searchsorted(owner, np.arange(keys.num_rows + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (starts, ends)]
    yield from pa.table([keys.column("key"), keys.column(SHARD), *lists], schema=schema).to_batches()


def _fold(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = pc.dictionary_encode(batch.column("key"))
            shards = batch.column(SHARD).to_numpy().astype(np.int64)
            pairs, first, owner = np.unique(coded.indices.to_numpy() * (shards.max() + 1) + shards, return_index=True, return_inverse=True)
            starts, ends = batch.column("from_us").to_numpy(), batch.column("through_us").to_numpy()
            order = np.argsort(owner, kind="stable")
            keys = pa.Table.from_batches([batch]).select(["key", SHARD]).take(pa.array(first))
            yield from _lists(keys, *merge_lists(owner[order], starts[order], ends[order]), schema)

    return run


def _merge(schema: pa.Schema):
    """Merges the lists of each (key, shard), sorted by these, in rounds of two by two; then (key, shard, kind, from, through):
    periods and gaps, or of hot keys parts, the periods of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, ["key", SHARD]):
            marks = starts_of(table, ["key", SHARD])
            heads = np.flatnonzero(marks)
            place = np.arange(len(marks)) - np.repeat(heads, np.diff(np.append(heads, len(marks))))  # of a list among its key's
            group = np.cumsum(marks) - 1
            columns = [pc.list_flatten(table.column(c)).to_numpy() for c in ("starts", "ends")]
            sizes = pc.list_value_length(table.column("starts")).to_numpy()
            of, at = np.repeat(group, sizes), np.repeat(place, sizes)
            wide = int(place.max()) + 1
            starts, ends = columns
            while True:
                owner = of * wide + at // 2
                owner, starts, ends = merge_lists(owner, starts, ends)
                of, at = owner // wide, owner % wide
                if not at.any():
                    break
            hot = table.column("hot").to_numpy()[heads][of]
            heads = pa.array(heads)
            keys = table.select(["key", SHARD]).take(heads)
            last = np.append(of[1:] != of[:-1], True)
            gaps = np.flatnonzero(~last & ~hot)
            kinds = pa.array(np.where(hot, "part", "period"))
            for who, kind, a, b in ((of, kinds, starts, ends), (of[gaps], pa.array(["gap"] * len(gaps)), ends[gaps], starts[gaps + 1])):
                own = keys.take(pa.array(who))
                yield from pa.table([own.column("key"), own.column(SHARD), kind.cast(pa.string()), pa.array(a), pa.array(b)], schema=schema).to_batches()

    return run


def continuous_periods(df: DataFrame, key: str, start: str, end: str, target_rows: int | None = None) -> DataFrame:
    """One row (key, kind, from_us, through_us) for each maximal joined closed interval (kind period) and for each
    stretch between two successive periods of a key (kind gap).

    Intervals belong together when one begins not later than the other ends. Rows with a null key, start or end, or
    whose start is not before the end, cover nothing. Repeated rows and ties change nothing; an empty table gives an
    empty result; other columns of df are ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    need(df, key, start, end)
    rows = df.select(F.col(f"`{key}`").alias("key"), micros(df, start).alias("from_us"), micros(df, end).alias("through_us"))
    rows = rows.filter("key is not null and from_us < through_us")
    plan = plan_shards(rows, ["key"], "from_us", target_rows)
    placed = plan.assign(rows).select("key", "from_us", "through_us", SHARD)
    instants = T.ArrayType(T.LongType(), False)
    listed = T.StructType([placed.schema["key"], placed.schema[SHARD], T.StructField("starts", instants), T.StructField("ends", instants)])
    merged = T.StructType([placed.schema["key"], placed.schema[SHARD], T.StructField("kind", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("from_us", "through_us"))])
    plain = lambda s: pa.schema([pa.field(f.name, pa.list_(pa.int64()) if pa.types.is_list(f.type) else f.type) for f in to_arrow_schema(s)])
    lists = placed.mapInArrow(_fold(plain(listed)), listed)
    lists = lists.withColumn("hot", F.lit(False)) if not plan.hot else lists.join(F.broadcast(plan.bounds.select("key", F.lit(True).alias("hot"))), "key", "left").na.fill(False, ["hot"])
    found = lists.repartition("key", SHARD).sortWithinPartitions("key", SHARD).mapInArrow(_merge(plain(merged)), merged)
    columns = ["key", "kind", "from_us", "through_us"]
    if not plan.hot:
        return found.select(columns)
    found = plan.keep(found)
    return found.filter("kind <> 'part'").select(columns).unionByName(_across_shards(plan, found.filter("kind = 'part'")).select(columns))


def _across_shards(plan: ShardPlan, parts: DataFrame) -> DataFrame:
    """Periods and gaps of hot keys from the disjoint periods of each of their shards. Those that begin within what earlier
    shards reach lengthen the last period before them; of each shard these, as one, and the last period take part in that,
    at most 2 * (2 * MAX_HOT + 1) rows."""
    ends = parts.groupBy("key", SHARD).agg(F.max("through_us").alias("end"))
    rows = parts.join(F.broadcast(plan.carry_in(ends, F.max("end"))), ["key", SHARD], "left")
    rows = rows.withColumn("head", F.coalesce(F.col("_carry0") >= F.col("from_us"), F.lit(False)))
    heads = rows.filter("head").groupBy("key", SHARD).agg(F.min("from_us").alias("from_us"), F.max("through_us").alias("through_us"))
    own = rows.filter("not head").select("key", SHARD, "from_us", "through_us")
    lasts = own.groupBy("key", SHARD).agg(F.max_by(F.struct("from_us", "through_us"), "from_us").alias("p")).select("key", SHARD, "p.*")
    along = Window.partitionBy("key").orderBy(SHARD, "seq").rowsBetween(Window.unboundedPreceding, 0)
    edges = heads.withColumn("seq", F.lit(0)).unionByName(lasts.withColumn("seq", F.lit(1))).withColumn("run", F.sum("seq").over(along))
    mended = edges.groupBy("key", "run").agg(F.min_by(SHARD, "from_us").alias(SHARD), F.min("from_us").alias("from_us"), F.max("through_us").alias("through_us")).drop("run")
    inner = own.join(F.broadcast(lasts.select("key", SHARD, "from_us")), ["key", SHARD, "from_us"], "left_anti")
    periods = inner.select("key", SHARD, "from_us", "through_us").unionByName(mended.select("key", SHARD, "from_us", "through_us"))
    firsts = periods.groupBy("key", SHARD).agg(F.min("from_us").alias("first"))
    spine = F.broadcast(plan.shards).join(F.broadcast(firsts), ["key", SHARD], "left")
    after = Window.partitionBy("key").orderBy(SHARD).rowsBetween(1, Window.unboundedFollowing)
    nexts = spine.select("key", SHARD, F.min("first").over(after).alias("_next"))
    later = F.coalesce(F.lead("from_us").over(Window.partitionBy("key", SHARD).orderBy("from_us")), "_next")
    both = periods.join(F.broadcast(nexts), ["key", SHARD], "left").withColumn("later", later)
    piece = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("from_us"), F.col(b).alias("through_us"))
    out = F.array_compact(F.array(piece("period", "from_us", "through_us"), F.when(F.col("later").isNotNull(), piece("gap", "through_us", "later"))))
    return both.select("key", F.explode(out).alias("x")).select("key", "x.*")
