"""Simple cycles of any length: one search for each first edge, inside its strong component."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.operators.graph_algo import strong_components
from lantern.runtime import cut, small_batches

#: Cycles that go to Spark at once from a search.
BATCH = 5_000


def circuits(out: dict[int, list[int]], start: int, second: int) -> Iterator[list[int]]:
    """The simple cycles that begin with the edge from ``start`` to ``second``, in a graph of which every node has a way to ``start``.

    A node that led back to the start by no way that was open is barred until a node after it comes
    free again, so between two cycles no edge is tried more than twice.
    """
    path, barred, waiting = [start, second], {start, second}, defaultdict(set)
    ways, closes = [iter(out[second])], [False]
    while ways:
        to = next(ways[-1], None)
        if to is None:
            ways.pop()
            gone = path.pop()
            if not closes.pop():
                for later in out[gone]:
                    waiting[later].add(gone)
                continue
            if closes:
                closes[-1] = True
            free = [gone]
            while free:
                node = free.pop()
                if node in barred:
                    barred.discard(node)
                    free.extend(waiting.pop(node, ()))
        elif to == start:
            closes[-1] = True
            yield list(path)
        elif to not in barred:
            barred.add(to)
            path.append(to)
            ways.append(iter(out[to]))
            closes.append(False)


def after(edges: list[tuple[int, int]], start: int) -> dict[int, list[int]]:
    """The nodes that follow each node among those from ``start`` on that have a way to it."""
    into = defaultdict(list)
    for a, b in edges:
        if a >= start and b >= start:
            into[b].append(a)
    seen, todo = {start}, [start]
    while todo:
        for a in into[todo.pop()]:
            if a not in seen:
                seen.add(a)
                todo.append(a)
    out = defaultdict(list)
    for a, b in edges:
        if a in seen and b in seen:
            out[a].append(b)
    return out


def _search(most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []

        def flush() -> pd.DataFrame:
            frame = pd.DataFrame(rows, columns=["component", "nodes", "more"])
            rows.clear()
            return frame

        for pdf in frames:
            for component, pairs, chunk, chunks in zip(pdf["component"], pdf["pairs"], pdf["chunk"], pdf["chunks"], strict=True):
                pairs = [(p["source"], p["target"]) for p in pairs]
                names = sorted({x for p in pairs for x in p})
                at = {name: i for i, name in enumerate(names)}
                edges = sorted((at[a], at[b]) for a, b in pairs)
                start, out = None, None
                for i, (a, b) in enumerate(edges):
                    if i % chunks != chunk or a > b:
                        continue
                    if a != start:
                        start, out = a, after(edges, a)
                    if b not in out:
                        continue
                    for n, cycle in enumerate(circuits(out, a, b)):
                        if n == most:
                            rows.append((component, [names[a], names[b]], True))
                            break
                        rows.append((component, [names[x] for x in cycle], False))
                        if len(rows) >= BATCH:
                            yield flush()
        if rows:
            yield flush()

    return run


def list_cycles(edges: DataFrame, most: int = 10_000, most_edges: int = 20_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All simple directed cycles of two nodes or more, the components with more than were listed, and the edges that were not searched.

    The first frame is ``component, nodes``, each cycle once from its least node on; the second
    ``component, members``. Cycles are searched for each edge that a cycle can begin with, from its least
    node: an edge lists ``most`` of them, and its component is in the second frame only if there is
    another. The edges of a strong component are one row, its searches are dealt to tasks in chunks, and
    cycles leave a task as they are found. Components of over ``most_edges`` edges are not gathered; their
    edges are the third frame, for a search by joins. Loops are no cycles here; edges with a null end
    and repeated edges change nothing; no edges give no rows.
    """
    small_batches(edges.sparkSession, 64)
    live = edges.where("source <> target").select("source", "target").distinct()
    parts = strong_components(live)
    of = lambda column, name: parts.select(F.col("node").alias(column), F.col("component").alias(name))
    inside = cut(live.join(of("source", "component"), "source").join(of("target", "d"), "target").where("component = d").select("component", "source", "target"))
    sizes = inside.groupBy("component").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > most_edges).select("component")
    small = inside.join(sizes.where(F.col("n") <= most_edges), "component")
    packed = small.groupBy("component", "n").agg(F.collect_list(F.struct("source", "target")).alias("pairs"))
    chunks = F.least(F.lit(256), F.ceil(F.col("n") / 16)).cast("int")
    dealt = packed.withColumn("chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("component", "pairs", "chunk", "chunks").repartition("component", "chunk")
    kind = edges.schema["source"].dataType.simpleString()
    found = cut(dealt.mapInPandas(_search(most), f"component {kind}, nodes array<{kind}>, more boolean"))
    more = found.where("more").select("component").distinct()
    members = parts.join(more, "component", "left_semi").groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    rest = inside.join(large, "component", "left_semi").select("source", "target")
    return found.where("not more").select("component", "nodes"), members, rest
