"""Problem 9: items of varying length in containers of fixed capacity.

Only the histogram of lengths comes to the driver; it has as many entries as the capacity times LEAST_SALTS, and one more for
each ROWS_OF_SALT items.
Lengths are grouped into classes; shallow combinations (at most three different classes, each repeated) that fill a
container to within a window are enumerated, non-negative least squares says how often each is used so that the classes
are used up, the counts are rounded down, and what is left is packed greedily, the longest first, into the fullest
container it fits: into the room left by the combinations, then into new containers. All of this counts containers by
kind; the resulting table of (length, rank) ranges is then applied to every item where it lies.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shared_path
from tidemark.tables import need

CAPACITY = 2048
WINDOW = 16  # tokens that a combination may leave unfilled
THIRDS = 4  # of the third classes that complete two others, the best so many are enumerated
HELD_BACK = (0.5, 0.25)  # shares of all tokens, in the shortest items, kept to fill the room that combinations leave: each is tried
ROWS_OF_SALT, LEAST_SALTS = 2_000_000, 8


def class_edges(capacity: int) -> np.ndarray:
    """The largest size of each class of lengths: single sizes up to 32, then ever wider classes, of at most 16 sizes."""
    edges, size = [], 0
    while size < capacity:
        size = min(capacity, size + min(16, max(1, size // 16)))
        edges.append(size)
    return np.array(edges, dtype=np.int64)


def combinations(edges: np.ndarray, present: np.ndarray, capacity: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(classes, repeats), each with three columns: what fills a container to within the window, with every item as large
    as its class allows. One class; two, the larger at most 8 times; or three, the two larger ones at most twice each."""
    size = edges[present]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(*parts: tuple) -> None:
        n = np.size(parts[-1][0])
        parts = [*parts, *[(present[0], 0)] * (3 - len(parts))]
        found.append((np.stack([np.broadcast_to(c, n) for c, _ in parts], 1), np.stack([np.broadcast_to(k, n) for _, k in parts], 1)))

    whole = capacity // size
    fits = (capacity - whole * size) <= window
    keep((present[fits], whole[fits]))
    for a in range(len(size) - 1, -1, -1):
        for i in range(1, min(8, capacity // size[a]) + 1):
            left = capacity - i * size[a]
            smaller = size[:a]
            j = left // smaller
            fits = (j > 0) & (left - j * smaller <= window)
            keep((present[a], i), (present[:a][fits], j[fits]))
            if i > 2:
                continue
            for b in range(a - 1, 0, -1):
                for j in (1, 2):
                    rest = left - j * size[b]
                    if rest <= 0:
                        continue
                    k = rest // size[:b]
                    unfilled = np.where(k > 0, rest - k * size[:b], capacity)
                    best = np.argpartition(unfilled, THIRDS)[:THIRDS] if b > THIRDS else np.arange(b)
                    best = best[unfilled[best] <= window]
                    keep((present[a], i), (present[b], j), (present[best], k[best]))
    return np.concatenate([c for c, _ in found]), np.concatenate([k for _, k in found])


def nonnegative_least_squares(classes: np.ndarray, repeats: np.ndarray, wanted: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, weights) of combinations, weights >= 0, whose sum comes near `wanted`, by the active set method: the one
    that would help most joins, and those whose weight falls to zero leave. At most one for each class stays active."""
    active: list[int] = []
    columns = np.zeros((len(wanted), 0))
    weights = np.zeros(0)
    scale = np.maximum(np.sqrt((repeats.astype(np.float64) ** 2).sum(axis=1)), 1e-9)
    for _ in range(rounds if len(classes) else 0):
        rest = wanted - columns @ weights
        gain = (rest[classes] * repeats).sum(axis=1) / scale
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-6 * max(1.0, float(np.abs(wanted).max())):
            break
        column = np.zeros(len(wanted))
        np.add.at(column, classes[best], repeats[best])
        active.append(best)
        columns = np.column_stack((columns, column))
        weights = np.append(weights, 0.0)
        while active:
            tried, *_ = np.linalg.lstsq(columns, wanted, rcond=None)
            falling = tried <= 1e-9
            if not falling.any():
                weights = tried
                break
            step = np.min(np.where(falling, weights / np.maximum(weights - tried, 1e-12), np.inf))
            weights = weights + step * (tried - weights)
            keep = weights > 1e-9
            active, weights, columns = [a for a, k in zip(active, keep, strict=True) if k], weights[keep], columns[:, keep]
    return np.array(active, dtype=np.int64), weights


@dataclass
class PackingPlan:
    """Items of `size` with ranks from..from + count go, `each` to a container, to the containers from `container` on."""

    capacity: int
    sizes: np.ndarray
    ranks: np.ndarray
    containers: np.ndarray
    each: np.ndarray
    n_containers: int

    def place(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        span = np.int64(1) << 40
        at = np.searchsorted(self.sizes * span + self.ranks, size.astype(np.int64) * span + rank, side="right") - 1
        return self.containers[at] + (rank - self.ranks[at]) // self.each[at]


def plan_packing(histogram: np.ndarray, window: int = WINDOW, held_back: tuple[float, ...] = HELD_BACK) -> PackingPlan:
    """The plan with the fewest containers of those that hold back each of these shares."""
    return min((_plan_packing(histogram, window, share) for share in held_back), key=lambda p: p.n_containers)


def _plan_packing(histogram: np.ndarray, window: int, held_back: float) -> PackingPlan:
    """The plan for histogram[s] items of each size s in 0..capacity (none of size 0)."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    used = np.zeros(capacity + 1, np.int64)  # ranks given out, by size
    ranges: list[tuple[int, int, int, int]] = []
    made = 0
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> ranges of containers (first, count)

    def give(size: int, count: int, container: int, each: int) -> None:
        ranges.append((size, int(used[size]), container, each))
        used[size] += count
        left[size] -= count

    if left[capacity]:
        give(capacity, int(left[capacity]), 0, 1)
        made = int(used[capacity])
    edges = class_edges(capacity)
    below = np.concatenate(([0], edges[:-1]))
    of_class = lambda u: range(int(edges[u]), int(below[u]), -1)
    mass = np.cumsum(np.arange(capacity + 1) * left)
    shortest = int(np.searchsorted(mass, held_back * mass[-1], side="right"))
    wanted = np.array([left[max(a, shortest) + 1 : b + 1].sum() for a, b in zip(below, edges, strict=True)], dtype=np.float64)
    present = np.flatnonzero(wanted)
    if len(present):
        classes, repeats = combinations(edges, present, capacity, window)
        rows, weights = nonnegative_least_squares(classes, repeats, wanted, 3 * len(present))
        free = wanted.astype(np.int64)
        for r in np.argsort(-weights, kind="stable"):
            if weights[r] < 1:
                break
            parts = [(int(c), int(k)) for c, k in zip(classes[rows[r]], repeats[rows[r]], strict=True) if k]
            repeat = min([int(weights[r] + 1e-6), *(int(free[u]) // n for u, n in parts)])
            for u, n in parts:
                free[u] -= repeat * n
            while repeat > 0:
                # the largest sizes left of each class; a run ends where one of them is used up
                fills: list[tuple[int, int]] = []
                taken: dict[int, int] = defaultdict(int)
                run = repeat
                for u, n in parts:
                    need_n = n
                    for s in of_class(u):
                        here = int(left[s]) - taken[s]
                        if here <= 0 or s <= shortest:
                            continue
                        m = min(need_n, here)
                        fills.append((s, m))
                        taken[s] += m
                        need_n -= m
                        if not need_n:
                            break
                for s, m in fills:
                    run = min(run, max(1, int(left[s]) // m))
                for s, m in fills:
                    give(s, run * m, made, m)
                room = capacity - sum(s * m for s, m in fills)
                if room:
                    rooms[room].append((made, run))
                made += run
                repeat -= run
    # the rest, longest first, each into the fullest container it fits
    open_rooms = np.zeros(capacity + 1, dtype=bool)
    for room in rooms:
        open_rooms[room] = True
    for s in range(capacity, 0, -1):
        while left[s]:
            fitting = np.flatnonzero(open_rooms[s:])
            if len(fitting):
                room = s + int(fitting[0])
                first, count = rooms[room].pop()
                m = min(room // s, int(left[s]))
                take = min(count, max(1, int(left[s]) // m))
                give(s, take * m, first, m)
                if count > take:
                    rooms[room].append((first + take, count - take))
                if not rooms[room]:
                    open_rooms[room] = False
                rest = room - s * m
            else:
                m = min(capacity // s, int(left[s]))
                take = max(1, int(left[s]) // m)
                first, rest = made, capacity - s * m
                give(s, take * m, first, m)
                made += take
            if rest:
                rooms[rest].append((first, take))
                open_rooms[rest] = True
    table = np.array(sorted(ranges), dtype=np.int64).reshape(-1, 4)
    return PackingPlan(capacity, table[:, 0], table[:, 1], table[:, 2], table[:, 3], made)


def pack_items(sizes: DataFrame, item_id: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(item_id, piece_no, n_tokens, container_id): every item, whole, in one container; only an item larger than the
    capacity is split, into full pieces and a rest.

    No container holds more than the capacity; containers are numbered from 0 without gaps. Items of null, zero or
    negative size are left out. Rows are items, repeated ones and null ids too; an empty table gives an empty result.
    """
    need(sizes, item_id, size)
    spark = sizes.sparkSession
    rows = sizes.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{size}`").cast("bigint").alias("n")).filter("n > 0")
    rows = rows.withColumn("spread", F.when(F.col("item_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("item_id")))
    folder = shared_path(spark, "sizes")  # lengths may be dear to make and are read again; what spreads null ids must not change
    rows.write.parquet(folder)
    rows = spark.read.schema(rows.schema).parquet(folder)
    pieces = rows.select("item_id", "n", "spread", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {capacity}"))).alias("piece_no"))
    pieces = pieces.withColumn("size", F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("piece_no") * capacity).cast("int")).drop("n")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("size").count().collect():  # at most capacity rows
        histogram[r["size"]] = r["count"]
    salts = np.maximum(LEAST_SALTS, -(-histogram // ROWS_OF_SALT))  # ranks of a size are given by salt, however many it holds
    first = np.cumsum(salts) - salts
    table = F.broadcast(spark.createDataFrame([(int(s), int(salts[s])) for s in np.flatnonzero(histogram)], "size int, salts int"))  # at most capacity rows
    pieces = pieces.join(table, "size").withColumn("salt", F.pmod(F.xxhash64("spread", "piece_no"), F.col("salts")).cast("int"))
    counts = np.zeros(int(salts.sum()), dtype=np.int64)
    for r in pieces.groupBy("size", "salt").count().collect():  # capacity * LEAST_SALTS rows, and one for each ROWS_OF_SALT items
        counts[first[r["size"]] + r["salt"]] = r["count"]
    plan = plan_packing(histogram)
    before = np.cumsum(counts) - counts
    before -= np.repeat(before[np.minimum(first, len(before) - 1)], salts)
    shared = spark.sparkContext.broadcast((plan, first, before))

    def container(size: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.Series:
        made, begin, offset = shared.value
        s = size.to_numpy()
        return pd.Series(made.place(s, offset[begin[s] + salt.to_numpy()] + rank.to_numpy(dtype=np.int64)))

    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy("item_id", "piece_no", "spread")) - 1)
    found = F.pandas_udf(container, T.LongType())("size", "salt", "rank")
    return ranked.select("item_id", "piece_no", F.col("size").alias("n_tokens"), found.alias("container_id"))
