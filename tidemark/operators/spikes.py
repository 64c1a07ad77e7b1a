"""Problem 6: implausible measurements, relative to how each source normally moves.

Physical bounds drop impossible readings. A Hampel filter then compares each reading with a rolling median, on a scale of
median absolute deviations. There are two filters over the same pass:

* `block`: the window is a block of one to three readings and its two neighbours, and the neighbours together weigh as
  much as the block. Its median is then the block's median held between the two neighbours, so a block that lies beyond
  both of them lies beyond the rolling median by its distance from the nearer neighbour, whatever its length, and a lasting
  change of level is none. The deviation is that of the source: the median absolute log change between readings.
* `plain`: the window is the reading and `half` readings on either side, with the window's own median and median absolute
  deviation (times 1.4826, as for normal noise), and the source's median absolute log change where that is zero.

They differ where the window's own deviation is not the source's: after a quiet stretch `plain` flags moves that are usual
for the source, in a wild one it misses spikes, and a block of three in a window of seven may widen its own scale.

Stuck values are runs of equal readings. Readings are sorted by source and time once and worked on as arrays; a rolling
median has no equal among the built-in functions. Hot sources are cut into time shards with a halo of HALO readings on
either side; their median is exact and needs no group in one task: a histogram over the leading bits of the changes finds
the two middle buckets of each source, and only those are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.groups import whole_groups
from tidemark.tables import micros, need
from tidemark.timeshard import SHARD, ShardPlan, plan_shards

NUMBER = r"^[\t\n\r ]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[\t\n\r ]*$"
HALO = 12
NORMAL = 1.4826


def parse_number(column: str):
    """A number written in ASCII digits, white space around it allowed, as a double; anything else is null. A column of numbers is read as text first."""
    return F.when(F.col(column).rlike(NUMBER), F.col(column).try_cast("double"))  # the cast drops the white space


def grouped_median(values: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """The median of each group's values, the mean of the middle two if even; nan for an empty group."""
    order = np.lexsort((values, group))
    values, sizes = values[order], np.bincount(group, minlength=n_groups)
    first = np.cumsum(sizes) - sizes
    out = np.full(n_groups, np.nan)
    some = sizes > 0
    out[some] = (values[(first + (sizes - 1) // 2)[some]] + values[(first + sizes // 2)[some]]) / 2
    return out


def beyond_neighbours(lx: np.ndarray, group: np.ndarray) -> np.ndarray:
    """By how much each reading's block, at best, lies beyond the rolling median of the block and its two neighbours: the
    least of its members' distances to one side. At most zero, or -inf, for no block."""
    best = np.full(len(lx), -np.inf)
    for size in (1, 2, 3):
        if len(lx) < size + 2:
            break
        windows = np.lib.stride_tricks.sliding_window_view(lx, size + 2)
        block = windows[:, 1:-1]
        low, high = block.min(axis=1), block.max(axis=1)
        middle = np.median(block, axis=1) if size > 2 else (low + high) / 2
        rolling = np.clip(middle, np.minimum(windows[:, 0], windows[:, -1]), np.maximum(windows[:, 0], windows[:, -1]))
        beyond = np.where(group[: len(windows)] == group[size + 1 :], np.maximum(low - rolling, rolling - high), -np.inf)
        for i in range(1, size + 1):
            np.maximum(best[i : i + len(beyond)], beyond, out=best[i : i + len(beyond)])
    return best


def rolling_deviation(lx: np.ndarray, group: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Each reading's distance from the median of the window of half readings on either side, cut off at the group's ends,
    and the window's median absolute deviation."""
    at = np.arange(len(lx))[:, None] + np.arange(-half, half + 1)[None, :]
    inside = (at >= 0) & (at < len(lx))
    at = np.clip(at, 0, max(len(lx) - 1, 0))
    window = np.where(inside & (group[at] == group[:, None]), lx[at], np.nan)
    median = np.nanmedian(window, axis=1)
    return np.abs(lx - median), np.nanmedian(np.abs(window - median[:, None]), axis=1)


def _flag(out_schema: pa.Schema, factor: float, stuck_run: int, rule: str, half: int):
    """Rows (key, id, kind, size): impossible, stuck and spike; of hot sources, in place of spikes, move with the size of a
    change and block with how far beyond, to be compared when the source's median is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["key", SHARD]):
            x, halo, hot = (table.column(c).to_numpy() for c in ("x", "halo", "hot"))
            same = np.zeros(table.num_rows, bool)  # the same reading as the row before
            t = table.column("t").to_numpy()
            ids = table.column("id")
            same[1:] = (group[1:] == group[:-1]) & (t[1:] == t[:-1]) & pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)), False).to_numpy() if len(ids) > 1 else False
            if ids.null_count:
                none = pc.is_null(ids).to_numpy()
                same[1:] |= (group[1:] == group[:-1]) & (t[1:] == t[:-1]) & none[1:] & none[:-1]
            reading = np.cumsum(~same)
            bad = np.flatnonzero((x <= 0) & ~halo)
            bad = bad[np.append(True, np.diff(reading[bad]) != 0)[: len(bad)]]
            good = np.flatnonzero(x > 0)
            good = good[np.append(True, np.diff(reading[good]) != 0)[: len(good)]]
            found = [(bad, "impossible", None)]
            if len(good):
                found += _flag_good(good, x[good], halo[good], hot[good], group[good], factor, stuck_run, rule, half)
            for at, kind, size in found:
                if len(at):
                    part = table.select(["key", "id"]).take(pa.array(at))
                    sizes = pa.nulls(len(at), pa.float64()) if size is None else pa.array(size)
                    yield from pa.table([part.column("key"), part.column("id"), pa.array([kind] * len(at)), sizes], schema=out_schema).to_batches()

    return run


def _flag_good(at: np.ndarray, x: np.ndarray, halo: np.ndarray, hot: np.ndarray, group: np.ndarray, factor: float, stuck_run: int, rule: str, half: int) -> list[tuple]:
    lx, group = np.log(x), group - group[0]
    follows = np.append(False, group[1:] == group[:-1])
    again = follows & np.append(False, x[1:] == x[:-1])
    runs = np.cumsum(~again) - 1
    own = ~halo
    stuck = again & own & (np.bincount(runs)[runs] >= stuck_run)
    moved = follows & ~again & own
    move = np.zeros(len(x))
    move[1:] = np.abs(lx[1:] - lx[:-1])
    moved &= move > 0
    scale = grouped_median(move[moved], group[moved], int(group[-1]) + 1)[group]
    if rule == "block":
        beyond = beyond_neighbours(lx, group)
        decided = np.zeros(len(x), bool)
    else:
        beyond, deviation = rolling_deviation(lx, group, half)
        beyond = beyond / NORMAL
        decided = own & (deviation > 0) & (beyond > factor * deviation)
        beyond[deviation > 0] = -np.inf
    spike = decided | (own & ~hot & (beyond > factor * np.where(np.isnan(scale), np.inf, scale)))
    later, moves = own & hot & (beyond > 0), moved & hot
    return [(at[stuck], "stuck", None), (at[spike], "spike", None), (at[moves], "move", move[moves]), (at[later], "block", beyond[later])]


def flag_readings(df: DataFrame, source: str, at: str, reading_id: str, value: str, factor: float = 14.0, stuck_run: int = 10, target_rows: int | None = None, rule: str = "block", half: int = 3) -> DataFrame:
    """Rows (source, reading_id, kind) for faulty readings, kind one of impossible, stuck, spike; a reading that is both
    stuck and a spike has two rows.

    Readings of a source are taken in order of at, then reading_id, each once (of repeated rows the smallest value
    above zero); rows with a null source, time, or a value that is null or no finite number are skipped.
    impossible: not above zero; such rows are skipped for the rest. stuck: every row but the first of a run of stuck_run
    or more equal values (at most HALO). spike, by rule `block`: one to three successive values all on the same side of both
    the value before and the value after them, each by more than factor times the source's typical move, the median of the
    absolute changes of log value between successive values, unchanged ones left out; a source that never moves has no
    spikes. By rule `plain`: a log value further from the median of its window (half readings on either side) than factor
    times the window's scaled median absolute deviation, or the typical move where that is zero.
    Other columns are ignored whatever their names; an empty table gives an empty result.
    """
    need(df, source, at, reading_id, value)
    if not 2 <= stuck_run <= HALO:
        raise ValueError(f"stuck_run must lie in 2..{HALO}")
    if rule not in ("block", "plain") or not 1 <= half <= HALO:
        raise ValueError(f"rule must be block or plain, half in 1..{HALO}")
    rows = df.select(F.col(f"`{source}`").alias("key"), micros(df, at).alias("t"), F.col(f"`{reading_id}`").alias("id"), F.col(f"`{value}`").cast("string").alias("value"))
    rows = rows.filter("key is not null and t is not null")
    read = rows.withColumn("x", parse_number("value")).drop("value").filter("x is not null and abs(x) < double('Infinity')")
    plan = plan_shards(rows.select("key", "t"), ["key"], "t", target_rows, least_rows=HALO, sized=read.filter("x > 0"), size=F.count_distinct(F.struct("t", "id")))
    placed = plan.assign(read, "hot").withColumn("halo", F.lit(False))
    if plan.hot:
        placed = placed.unionByName(_halo(plan, plan.assign(plan.rows, "hot").withColumn("halo", F.lit(False))))
    schema = T.StructType([read.schema["key"], read.schema["id"], T.StructField("kind", T.StringType()), T.StructField("size", T.DoubleType())])
    arrow = pa.schema([f if f.name in ("key", "id") else f for f in _arrow(schema)])
    line = placed.select("key", SHARD, "t", "id", "x", "halo", "hot").repartition("key", SHARD).sortWithinPartitions("key", SHARD, "t", "id", "x")
    found = line.mapInArrow(_flag(arrow, factor, stuck_run, rule, half), schema)
    if plan.hot:
        found = plan.keep(found)
        scale = exact_median(found.filter("kind = 'move'"), "key", "size")  # one row for each hot source at most
        late = found.filter("kind = 'block'").join(F.broadcast(scale), "key").filter(F.col("size") > factor * F.col("median"))
        found = found.filter("kind not in ('move', 'block')").select("key", "id", "kind").unionByName(late.select("key", "id", F.lit("spike").alias("kind")))
    return found.select(F.col("key").alias("source"), F.col("id").alias("reading_id"), "kind")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _halo(plan: ShardPlan, rows: DataFrame) -> DataFrame:
    """Copies of the HALO first readings of each shard of a hot source for the shard before, of the last for the one after."""
    w = Window.partitionBy("key", SHARD).orderBy("t", "id", "x")
    once = rows.withColumn("again", F.lag(F.struct("t", "id")).over(w).eqNullSafe(F.struct("t", "id"))).filter("not again").drop("again")
    both = once.withColumn("up", F.row_number().over(w)).withColumn("down", F.count("*").over(Window.partitionBy("key", SHARD)) - F.col("up"))
    edge = both.filter(f"up <= {HALO} or down < {HALO}").withColumn(
        "to", F.explode(F.array_compact(F.array(F.when(F.col("up") <= HALO, F.col(SHARD) - 1), F.when(F.col("down") < HALO, F.col(SHARD) + 1))))
    )
    return edge.filter("to >= 0").withColumn(SHARD, F.col("to")).withColumn("halo", F.lit(True)).select(*rows.columns)


def exact_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """The exact median (key, median) of the positive doubles of each key, the mean of the middle two if even.

    Only values in the buckets of the two middle ranks are ranked: a bucket is a power of two and its 4096th part; counts
    per bucket are combined before the shuffle. Equal values are one row with a count.
    """
    holds = lambda rank: F.max(F.when((F.col("from") < F.col(rank)) & (F.col("to") >= F.col(rank)), F.col("v")))
    lower, upper = F.floor((F.col("all") + 1) / 2), F.floor((F.col("all") + 2) / 2)
    values = df.select(F.col(key).alias("key"), F.col(value).alias("v"))
    power = F.floor(F.log2("v"))
    bucket = (power * 4096 + F.least(F.lit(4095), F.greatest(F.lit(0), F.floor((F.col("v") / F.pow(F.lit(2.0), power) - 1) * 4096)))).cast("bigint")
    counted = values.withColumn("bucket", bucket).groupBy("key", "bucket", "v").agg(F.count("*").alias("n"))
    hist = counted.groupBy("key", "bucket").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("key")
    ranked = hist.withColumn("upto", F.sum("n").over(along)).withColumn("all", F.sum("n").over(total))
    middle = ranked.filter((F.col("upto") >= lower) & (F.col("upto") - F.col("n") < upper)).select("key", "bucket", (F.col("upto") - F.col("n")).alias("below"), lower.alias("lower"), upper.alias("upper"))
    inside = counted.join(middle, ["key", "bucket"])
    order = Window.partitionBy("key", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("to", F.col("below") + F.sum("n").over(order)).withColumn("from", F.col("to") - F.col("n"))
    return inside.groupBy("key").agg(((holds("lower") + holds("upper")) / 2).alias("median"))
