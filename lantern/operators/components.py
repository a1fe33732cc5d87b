"""Weakly connected components by minimum label and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.runtime import cut, lookup


def union_find(left: list, right: list) -> dict:
    """Vertex -> smallest vertex of its component, over the given pairs."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for a, b in zip(left, right, strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        roots = union_find(pdf["src"].tolist(), pdf["dst"].tolist())
        yield pd.DataFrame({"src": list(roots.keys()), "dst": list(roots.values())})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every vertex of ``edges``; ``component`` is its smallest reachable vertex.

    Each batch of edges is first contracted to a star forest, which bounds what is shuffled by the
    vertices of the batch. Every round then takes the least neighbouring label, hooks roots to it
    and halves the paths; the number of rounds grows with the logarithm of the diameter. Labels are
    looked up through a broadcast where they are few, so a large component is no hot key, and
    checkpointed each round, so the plan stays short. Edges with a null end are ignored; no edges
    give no rows. Vertices may be of any orderable type.
    """
    kind = edges.schema[src].dataType.simpleString()
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    stars = pairs.mapInPandas(_contract, f"src {kind}, dst {kind}")
    stars = cut(stars.distinct())
    links = stars.where("src <> dst")
    both = links.union(links.select("dst", "src"))
    labels = cut(stars.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component")))
    for _ in range(max_rounds):
        near = lookup(both, labels, "dst = node", how="inner").groupBy(F.col("src").alias("near")).agg(F.min("component").alias("label"))
        seen = labels.join(near, F.expr("node = near"), "left").select("node", "component", F.least("component", F.coalesce("label", "component")).alias("least"))
        seen = cut(seen)
        lower = seen.where("least < component")
        if lower.isEmpty():
            return labels
        hooks = cut(lower.groupBy(F.col("component").alias("root")).agg(F.min("least").alias("hook")))
        hooked = cut(lookup(seen, hooks, "component = root").select("node", F.least("least", F.coalesce("hook", "least")).alias("component")))
        heads = hooked.select(F.col("component").alias("parent")).distinct()
        up = cut(hooked.where("component <> node").join(heads, F.expr("node = parent")).select("parent", F.col("component").alias("grand")))
        labels = cut(lookup(hooked, up, "component = parent").select("node", F.coalesce("grand", "component").alias("component")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
