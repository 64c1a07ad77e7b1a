"""Problem 3: the history of changing attributes as a bitemporal ledger.

Every update keeps its row, and every row is a rectangle of valid and recorded time. When an update comes to be recorded,
the row that until then ruled at its start loses the rest of its piece from there to the next start known by then: that
rest is split off and closed at the instant of recording, and the update takes its place. Nothing is overwritten, so for
each instant of valid and of recorded time one row tells what was believed.

What an update closes is told by two neighbours: in order of valid start, the nearest earlier row that was recorded before
it (whose piece it cuts) and the nearest later one (where the cut ends). One sweep along valid time finds both with a stack
of the rows that are not yet beaten; each row is put on it and taken off it once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.groups import whole_groups
from tidemark.tables import micros, need
from tidemark.timeshard import SHARD, ShardPlan, plan_shards

FOREVER = (1 << 63) - 1
BEFORE_ALL = -(1 << 63)


def nearest_recorded_before(rank: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of rows in order of group and valid start, rank telling the order of recording: the nearest row before it
    and the nearest one after it, within its group, with a lower rank; -1 where there is none."""
    before, after = np.full(len(rank), -1, np.int64), np.full(len(rank), -1, np.int64)
    stack: list[int] = []
    ranks: list[int] = []
    last = -1
    for i, (r, g) in enumerate(zip(rank.tolist(), group.tolist(), strict=True)):
        if g != last:
            stack.clear()
            ranks.clear()
            last = g
        while ranks and ranks[-1] > r:
            after[stack.pop()] = i
            ranks.pop()
        if stack:
            before[i] = stack[-1]
        stack.append(i)
        ranks.append(r)
    return before, after


def _sweep(names: list[str], schema: pa.Schema):
    """Each row (key, shard, values.., source, valid_from, valid_to, recorded_from), sorted and once, with its neighbours:
    prev_*, the row whose piece it cuts, cut_to, where the cut ends, and next_from, the next start of all."""
    order = ["recorded_from", "source", *names, "valid_to", "valid_from"]
    own = ["key", *names, "source", "valid_from", "valid_to", "recorded_from", SHARD]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["key", SHARD]):
            n = table.num_rows
            again = np.concatenate(([False], group[1:] == group[:-1]))
            for c in own[1:-1]:  # repeated rows are neighbours
                a, b = table.column(c).slice(1), table.column(c).slice(0, n - 1)
                again[1:] &= pc.fill_null(pc.or_kleene(pc.equal(a, b), pc.and_(pc.is_null(a), pc.is_null(b))), False).to_numpy()
            if again.any():
                table, group = table.filter(pa.array(~again)), group[~again]
                n = table.num_rows
            rank = np.empty(n, np.int64)
            rank[pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_start").to_numpy()] = np.arange(n)
            before, after = nearest_recorded_before(rank, group)
            start = table.column("valid_from").to_numpy()
            following = np.append(group[1:] == group[:-1], False)
            prev = pa.array(before, mask=before < 0)
            cols = {c: table.column(c) for c in own}
            cols |= {f"prev_{c}": table.column(c).take(prev) for c in own[1:-1]}
            cols["cut_to"] = pa.array(start[np.maximum(after, 0)], mask=after < 0)
            cols["next_from"] = pa.array(np.append(start[1:], 0), mask=~following)
            yield from pa.table([cols[f.name] for f in schema], schema=schema).to_batches()

    return run


def bitemporal_ledger(df: DataFrame, key: str, values: dict[str, Column], start: str, end: str, recorded: str, source: str, target_rows: int | None = None) -> tuple[DataFrame, ShardPlan]:
    """Ledger rows (key, values.., source, valid_from, valid_to, recorded_from, recorded_to, status, _shard), and the plan
    of their shards.

    values maps each attribute to an expression on df; the first one must not be null. Updates are recorded in order of
    recorded (null first), then source, values, end and start. At a recorded instant, of the rows known by then the one with the
    latest start not after a valid instant rules there, of the same start the one recorded last, until its own end; one row
    of the ledger covers that instant of both times. valid_to is exclusive, FOREVER if open; recorded_to is null while a
    row holds, and BEFORE_ALL where what took over was recorded at an unknown instant, which comes before all. status: `current` (holds now), `split` (the rest of a version that a later start took over at recorded_to),
    `superseded` (taken over by a row of the same start), `preempted` (such a piece that was recorded and taken over at one
    instant, so that it never ruled) and `void` (null key, null first value, null start, or an end not after the start;
    rules nowhere). Exact duplicates count once.
    """
    need(df, key, start, end, recorded, source)
    names = list(values)
    rows = df.select(
        F.col(f"`{key}`").alias("key"), *[v.alias(n) for n, v in values.items()], F.col(f"`{source}`").alias("source"),
        micros(df, start).alias("valid_from"), F.coalesce(micros(df, end), F.lit(FOREVER)).alias("valid_to"), micros(df, recorded).alias("recorded_from"),
    )
    void = F.col("key").isNull() | F.col(names[0]).isNull() | F.col("valid_from").isNull() | (F.col("valid_to") <= F.col("valid_from"))
    good = rows.filter(~void)
    plan = plan_shards(good, ["key"], "valid_from", target_rows)
    order = ["valid_from", F.col("recorded_from").asc_nulls_first(), F.col("source").asc_nulls_first(), *[F.col(n).asc_nulls_first() for n in names], "valid_to"]
    line = plan.assign(good).select("key", *names, "source", "valid_from", "valid_to", "recorded_from", SHARD)
    swept_schema = T.StructType([*line.schema, *[T.StructField(f"prev_{f.name}", f.dataType) for f in line.schema[1:-1]], T.StructField("cut_to", T.LongType()), T.StructField("next_from", T.LongType())])
    swept = line.repartition("key", SHARD).sortWithinPartitions("key", SHARD, *order).mapInArrow(_sweep(names, _arrow(swept_schema)), swept_schema)
    if plan.hot:
        swept = _beyond_shards(plan, swept, names)
    taken = F.col("next_from").eqNullSafe(F.col("valid_from"))
    now = F.struct(
        F.struct(*names, "source", "recorded_from").alias("of"), F.col("valid_from"), F.least("valid_to", F.coalesce("next_from", "valid_to")).alias("valid_to"),
        F.lit(None).cast("bigint").alias("recorded_to"), F.lit("current").alias("status"),
    )
    status = F.when(F.col("prev_recorded_from").eqNullSafe(F.col("recorded_from")), "preempted").when(F.col("prev_valid_from") == F.col("valid_from"), "superseded").otherwise("split")
    cut = F.struct(
        F.struct(*[F.col(f"prev_{c}").alias(c) for c in (*names, "source", "recorded_from")]).alias("of"), F.col("valid_from"), F.least("prev_valid_to", F.coalesce("cut_to", "prev_valid_to")).alias("valid_to"),
        F.coalesce("recorded_from", F.lit(BEFORE_ALL)).alias("recorded_to"), status.alias("status"),
    )
    pieces = swept.select("key", SHARD, F.explode(F.array_compact(F.array(F.when(~taken, now), F.when(F.col("prev_valid_to") > F.col("valid_from"), cut)))).alias("p"))
    cols = ["key", *names, "source", "valid_from", "valid_to", "recorded_from", "recorded_to", "status", SHARD]
    kept = pieces.select("key", *[f"p.of.{c}" for c in (*names, "source", "recorded_from")], "p.valid_from", "p.valid_to", "p.recorded_to", "p.status", SHARD)
    voided = rows.filter(void).distinct().select(*cols[: 3 + len(names)], F.when(F.col("valid_to") != FOREVER, F.col("valid_to")).alias("valid_to"), "recorded_from", F.lit(None).cast("bigint").alias("recorded_to"), F.lit("void").alias("status"), F.lit(0).alias(SHARD))
    return kept.select(cols).unionByName(voided.select(cols)), plan


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _beyond_shards(plan: ShardPlan, swept: DataFrame, names: list[str]) -> DataFrame:
    """Finds, for rows of hot keys, the neighbours that lie in other shards.

    The nearest earlier row recorded before a row is, in the nearest earlier shard that holds any recorded before it, the
    last of those that no later row of that shard beats; it is the one recorded last before the row. The nearest later row
    is, in the nearest such later shard, the first that beats all before it there; again the one recorded last before the
    row. Either is found on one line by order of recording within (key, that shard)."""
    checked = plan.keep(swept)
    recorded = F.struct("recorded_from", "source", *names, "valid_to", "valid_from")
    rows = plan.only_hot(checked).withColumn("_at", recorded)
    whole = Window.partitionBy("key").orderBy(SHARD)
    lows = rows.groupBy("key", SHARD).agg(F.min("_at").alias("low"), F.min("valid_from").alias("first"))
    spine = F.broadcast(plan.shards).join(F.broadcast(lows), ["key", SHARD], "left")
    marks = spine.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col(SHARD).alias("s"), "low"))).alias("_lows"))  # one list for each hot key, of its shards
    nexts = spine.select("key", SHARD, F.min("first").over(whole.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    rows = rows.join(F.broadcast(marks), "key").join(F.broadcast(nexts), ["key", SHARD])
    lower = F.filter("_lows", lambda m: m["low"] < F.col("_at"))
    left = F.array_max(F.transform(F.filter(lower, lambda m: m["s"] < F.col(SHARD)), lambda m: m["s"]))
    right = F.array_min(F.transform(F.filter(lower, lambda m: m["s"] > F.col(SHARD)), lambda m: m["s"]))
    beaten_by_none = F.col("cut_to").isNull()  # none later in its shard was recorded before it
    beats_all = F.col("prev_valid_from").isNull()  # none earlier in its shard was
    rows = rows.withColumn("_left", F.when(beats_all, left)).withColumn("_right", F.when(beaten_by_none, right)).drop("_lows")
    rows = rows.withColumn("next_from", F.coalesce("next_from", "_next")).drop("_next")
    own = F.struct(*names, "source", "valid_from", "valid_to", "recorded_from")

    def ask(which: str, candidates: Column, got: str, value: Column) -> DataFrame:
        asks = rows.filter(F.col(which).isNotNull()).select("key", F.col(which).alias("_s"), "_at", F.lit(1).alias("_turn"), F.lit(None).cast(rows.select(value.alias("v")).schema["v"].dataType).alias("_v"))
        answers = rows.filter(candidates).select("key", F.col(SHARD).alias("_s"), "_at", F.lit(0).alias("_turn"), value.alias("_v"))
        w = Window.partitionBy("key", "_s").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
        line = answers.unionByName(asks).withColumn(got, F.last("_v", ignorenulls=True).over(w))
        return line.filter("_turn = 1").select("key", "_at", got)

    prevs, cuts = ask("_left", beaten_by_none, "_prev", own), ask("_right", beats_all, "_cut", F.col("valid_from"))
    joined = rows
    for side in (prevs, cuts):
        on = (F.col("a.key") == F.col("b.key")) & F.col("a._at").eqNullSafe(F.col("b._at"))
        joined = joined.alias("a").join(side.alias("b"), on, "left").select("a.*", f"b.{side.columns[-1]}")
    found = [F.coalesce(F.col(f"prev_{c}"), F.col(f"_prev.{c}")).alias(f"prev_{c}") for c in (*names, "source", "valid_from", "valid_to", "recorded_from")]
    mended = joined.select("key", *names, "source", "valid_from", "valid_to", "recorded_from", SHARD, *found, F.coalesce("cut_to", "_cut").alias("cut_to"), "next_from")
    return plan.not_hot(checked).select(mended.columns).unionByName(mended)


def current_history(ledger: DataFrame, plan: ShardPlan, names: list[str]) -> DataFrame:
    """The maximal unbroken stretches (key, names.., valid_from, valid_to) of equal values among the current rows."""
    rows = ledger.filter("status = 'current'").select("key", SHARD, *names, "valid_from", "valid_to")
    local = _join_runs(rows, ["key", SHARD], names, ["valid_from"])
    if not plan.hot:
        return local.select("key", *names, "valid_from", "valid_to")
    # only the first and the last stretch of a shard can go on in another: at most two rows per shard of the hot keys
    whole = Window.partitionBy("key", SHARD)
    marked = local.withColumn("edge", (F.col("valid_from") == F.min("valid_from").over(whole)) | (F.col("valid_from") == F.max("valid_from").over(whole)))
    marked = marked.join(F.broadcast(plan.bounds.select("key").withColumn("hot", F.lit(True))), "key", "left").withColumn("edge", F.col("edge") & F.col("hot").isNotNull())
    mended = _join_runs(marked.filter("edge"), ["key"], names, ["valid_from"])
    cols = ["key", *names, "valid_from", "valid_to"]
    return marked.filter("not edge").select(cols).unionByName(mended.select(cols))


def _join_runs(rows: DataFrame, part: list[str], names: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    goes_on = F.lag("valid_to").over(w).eqNullSafe(F.col("valid_from"))
    for n in names:
        goes_on = goes_on & F.lag(n).over(w).eqNullSafe(F.col(n))
    runs = rows.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*part, "run").agg(*[F.max(n).alias(n) for n in names], F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to")).drop("run")
