"""Ranks by rounds over the called nodes alone."""

import random

import pytest
from pyspark.sql import functions as F

from lantern.operators.graph_algo import page_rank


def test_ranks_by_plain_rounds_and_nodes_read_once(spark):
    rng = random.Random(5)
    names = [f"n{i:02}" for i in range(40)]
    # The first ten are called by none, the last three are in no edge, and some ends are no nodes.
    pairs = {(s, t) for s, t in ((rng.choice(names[:37]), rng.choice(names[10:37])) for _ in range(60)) if s != t} | {("x", names[12]), (names[0], "y"), (names[20], names[20])}
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        read.add(1)
        return x

    nodes = spark.createDataFrame([(x,) for x in names], "node_id string").select(told.asNondeterministic()("node_id").alias("node_id"))
    found = {r["node_id"]: r["rank"] for r in page_rank(nodes, spark.createDataFrame(sorted(pairs), "source string, target string"), rounds=6).collect()}
    rank, ways = dict.fromkeys(names, 1 / 40), {n: sum(s == n for s, _ in pairs) for n in names}
    for _ in range(6):
        lost = sum(rank[n] for n in names if not ways[n])
        rank = {n: (0.15 + 0.85 * lost) / 40 + 0.85 * sum(rank[s] / ways[s] for s, t in pairs if t == n and s in rank) for n in names}
    assert found == {n: pytest.approx(v, abs=1e-12) for n, v in rank.items()}
    assert read.value == 40
