import random

import numpy as np
import pytest

from tabloom.llm import components
from tabloom.llm.components import connected_groups, union_find


def brute(pairs):
    group = {}
    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        ga, gb = group.setdefault(a, {a}), group.setdefault(b, {b})
        if ga is not gb:
            ga |= gb
            for x in gb:
                group[x] = ga
    return {(x, min(g, key=str.encode)) for x, g in group.items()}


def run(spark, pairs, **kw):
    df = spark.createDataFrame([(a, b, "c", "c") for a, b in pairs], "l string, r string, node string, root string")
    return {tuple(x) for x in connected_groups(df, "l", "r", **kw).collect()}


def test_union_find():
    rng = np.random.default_rng(0)
    left, right = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    root = union_find(left, right, 300)
    want = {f"{x:03}": r for x, r in brute([(f"{a:03}", f"{b:03}") for a, b in zip(left, right)])}
    assert all(f"{root[i]:03}" == want.get(f"{i:03}", f"{i:03}") for i in range(300))


@pytest.mark.parametrize("limit", [2_000_000, 25])
def test_random_graphs_and_edges(spark, limit):
    rng = random.Random(limit)
    pairs = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(110)]
    pairs += [(b, a) for a, b in pairs[:20]] + pairs[:20] + [("self", "self"), (None, "n1"), ("n2", None), ("é", "z")]
    assert run(spark, pairs, edges_per_task=limit) == brute(pairs)


def test_long_chain_and_hub_in_bounded_tasks(spark):
    chain = [(f"c{k:04}", f"c{k + 1:04}") for k in range(160)]
    random.Random(3).shuffle(chain)
    hub = [("a-hub", f"h{k:03}") for k in range(120)]
    assert run(spark, chain + hub, edges_per_task=60) == brute(chain + hub)


def test_same_groups_whatever_the_bound(spark, monkeypatch):
    monkeypatch.setattr(components, "REDUCE_EVERY", 7)
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(70)] + [(f"c{k:03}", f"c{k + 1:03}") for k in range(40)]
    got = [run(spark, pairs, edges_per_task=n) for n in (10, 40, 2_000_000)]
    assert got[0] == got[1] == got[2] == brute(pairs)


def test_empty(spark):
    assert run(spark, [("x", "x")]) == set()
    df = spark.createDataFrame([], "l string, r string")
    assert connected_groups(df, "l", "r").count() == 0
