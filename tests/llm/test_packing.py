"""Packing: nothing lost, nothing over capacity, little room left."""

import numpy as np
import pytest

from tidemark.llm.packing import class_edges, combinations, nonnegative_least_squares, pack_items, plan_packing


def placed(sizes, capacity=2048):
    h = np.bincount(sizes, minlength=capacity + 1)
    plan = plan_packing(h)
    s = np.sort(sizes)
    rank = np.arange(len(s)) - (np.cumsum(h) - h)[s]
    c = plan.place(s, rank)
    load = np.bincount(c, weights=s, minlength=plan.n_containers)
    assert load.max(initial=0) <= capacity and len(load) == plan.n_containers and (load > 0).all()
    return plan.n_containers, -(-int(s.sum()) // capacity)


@pytest.mark.parametrize("kind", ["lognormal", "uniform", "tiny", "one", "full", "halves", "single"])
def test_no_container_overflows(kind):
    rng = np.random.default_rng(1)
    sizes = {
        "lognormal": np.clip(rng.lognormal(5.3, 0.9, 20_000), 1, 2048).astype(int), "uniform": rng.integers(1, 2049, 20_000), "tiny": rng.integers(1, 20, 20_000), "one": np.full(5000, 683),
        "full": np.full(50, 2048), "halves": np.concatenate((np.full(100, 1025), np.full(100, 1023))), "single": np.array([7]),
    }[kind]
    made, bound = placed(sizes)
    if kind in ("lognormal", "tiny", "full", "halves", "single"):
        assert made <= bound * 1.005 + 1
    if kind == "one":
        assert made == 2500


def test_small_capacities():
    for capacity in (1, 2, 3, 10):
        made, bound = placed(np.random.default_rng(capacity).integers(1, capacity + 1, 300), capacity)
        assert made <= bound * 1.6 + 1


def test_combinations_fill_to_the_window():
    edges = class_edges(2048)
    present = np.flatnonzero(np.random.default_rng(0).random(len(edges)) < 0.3)
    classes, repeats = combinations(edges, present, 2048, 16)
    filled = (edges[classes] * repeats).sum(axis=1)
    assert len(filled) and filled.max() <= 2048 and filled.min() >= 2048 - 16


def test_least_squares_is_nonnegative_and_fits():
    classes, repeats = np.array([[0, 1, 0], [1, 2, 0], [0, 2, 0]]), np.array([[1, 2, 0], [1, 1, 0], [3, 1, 0]])
    wanted = np.array([5.0, 7.0, 2.0])
    rows, weights = nonnegative_least_squares(classes, repeats, wanted, 30)
    total = np.zeros(3)
    for r, w in zip(rows, weights):
        np.add.at(total, classes[r], repeats[r] * w)
    assert (weights > 0).all() and np.abs(total - wanted).max() < 3


def test_table(spark):
    rng = np.random.default_rng(2)
    data = [(int(i), int(n)) for i, n in enumerate(rng.integers(1, 900, 400))] + [(1000, 5000), (1000, 5000), (None, 40), (None, 40), (7, None), (8, 0), (9, -3)]
    df = spark.createDataFrame([(i, n, 1) for i, n in data], "id bigint, n bigint, size int")
    got = pack_items(df, "id", "n").collect()
    load = {}
    for r in got:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
    assert max(load.values()) <= 2048 and sorted(load) == list(range(len(load)))
    assert sum(load.values()) == sum(n for _, n in data if n and n > 0)
    split = [r for r in got if r["item_id"] == 1000]
    assert sorted((r["piece_no"], r["n_tokens"]) for r in split) == sorted([(0, 2048), (1, 2048), (2, 904)] * 2)
    assert len([r for r in got if r["item_id"] is not None and r["item_id"] < 400]) == 400
    assert pack_items(df.limit(0), "id", "n").count() == 0
