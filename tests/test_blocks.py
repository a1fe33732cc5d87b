"""Pairs in blocks, and the edges inferred from them, against plain pairs."""

from collections import Counter

import numpy as np
import pytest

from lantern.operators import graph_infer as M
from lantern.runtime import pairs_in_blocks


@pytest.mark.parametrize("most", [1, 7, 1_000])
def test_every_pair_once_in_each_order(spark, most):
    rows = [(i, "hot" if i % 4 else "b") for i in range(60)] + [(100, "one")]
    df = spark.createDataFrame(rows, "id long, key string").repartition(3)
    found = Counter((r["a"]["id"], r["b"]["id"]) for r in pairs_in_blocks(df, ["key"], "a", "b", "id", most).collect())
    assert found == Counter((i, j) for i, k in rows for j, m in rows if k == m)
    assert pairs_in_blocks(df.limit(0), ["key"], "a", "b", "id", most).count() == 0


def test_edges_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    names = [f"ns{i % 3}/app-{i}" for i in range(40)]
    weights = {}
    for n in names:
        places = rng.choice(10, size=3, replace=False)
        w = rng.random(3) + 0.1
        weights[n] = dict(zip(places.tolist(), (w / np.linalg.norm(w)).tolist(), strict=True))
    nodes = spark.createDataFrame([(n, i, n.split("/")[1], "x", "Deployment", float(rng.integers(12)) / 50) for i, n in enumerate(names)], "node_id string, seq long, name string, category string, kind string, error_rate double")
    vectors = spark.createDataFrame([(n, p, w) for n, own in weights.items() for p, w in own.items()], "node_id string, pos long, weight double")
    dot = lambda a, b: sum(w * weights[b].get(p, 0.0) for p, w in weights[a].items())
    want = {frozenset((a, b)): dot(a, b) for a in names for b in names if a < b and dot(a, b) > 0.7}
    rates = {r["node_id"]: r["error_rate"] for r in nodes.collect()}
    assert 20 < len(want) < 700
    for most in (5, 2_000):
        edges = M.embedding_edges(nodes, vectors, 0.7, most).collect()
        assert len(edges) == len(want) and {frozenset((r["source"], r["target"])): pytest.approx(r["confidence"]) for r in edges} == want
        assert Counter((r["source"], r["target"]) for r in M.error_edges(nodes, 0.05, most).collect()) == Counter((a, b) for a in names for b in names if rates[a] > rates[b] > 0.05)
        assert Counter((r["source"], r["target"]) for r in M.deployment_edges(nodes, most).collect()) == Counter((a, b) for a in names for b in names if a != b and a[:3] == b[:3])


def test_tasks_follow_the_pairs(spark):
    """300 rows of one key: the plan alone would join them in one small task."""
    rows = spark.range(300).selectExpr("0 as k", "id")
    found = pairs_in_blocks(rows, ["k"], "a", "b", "id", 30, task_pairs=4_500)
    assert found.rdd.getNumPartitions() == 21 and found.distinct().count() == 90_000
