"""Edges inferred from embeddings, traffic, errors and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.operators.graph_build import WORKLOADS, merge_edges
from lantern.runtime import cut, pairs_in_blocks

SIZE = 64


def _letters(text: Column, most: int, step: int, offset: int) -> Column:
    """(position, weight) of the first letters of a lower-cased text."""
    low = F.lower(text)
    at = F.sequence(F.lit(1), F.least(F.lit(most), F.length(low)))
    return F.when(
        F.length(low) > 0,
        F.transform(at, lambda i: F.struct(((i - 1) * step + offset).cast("int").alias("pos"), (F.ascii(F.substr(low, i, F.lit(1))) / 255.0).alias("w"))),
    )


def service_embedding(nodes: DataFrame) -> DataFrame:
    """``node_id, pos, weight``: the non-zero places of each node's unit vector of 64.

    Letters of name, kind and category, hashed labels and variables, and ports add up in fixed
    places. Labels and variables are hashed by xxhash64, which doesn't change between runs. Maps and
    port lists are optional columns ``labels``, ``environment`` and ``ports``.
    """
    parts = [_letters(F.coalesce("name", "node_id"), 10, 1, 0), _letters(F.coalesce("kind", F.lit("unknown")), 5, 2, 0), _letters(F.coalesce("category", F.lit("unknown")), 5, 2, 1)]
    spot = lambda x: F.pmod(F.xxhash64(x), F.lit(SIZE)).cast("int")
    add = lambda pos, w: F.struct(pos.alias("pos"), F.lit(w).alias("w"))
    if "labels" in nodes.columns:
        parts += [F.transform(F.map_keys("labels"), lambda k: add(spot(k), 0.5)), F.transform(F.map_values("labels"), lambda v: add(spot(v), 0.5))]
    if "ports" in nodes.columns:
        parts.append(F.transform("ports", lambda p: add(F.pmod(p, F.lit(SIZE)).cast("int"), 0.3)))
    if "environment" in nodes.columns:
        parts.append(F.transform(F.map_keys("environment"), lambda k: add(spot(k), 0.2)))
    empty = F.array().cast("array<struct<pos:int,w:double>>")
    # Nodes are dealt to tasks as they are, and each one's places are summed in its own row, so no task holds sums of many.
    named = [c for c in ("name", "kind", "category", "labels", "ports", "environment") if c in nodes.columns]
    own = nodes.select("node_id", *named).repartition("node_id").select("node_id", F.concat(*[F.coalesce(p, empty) for p in parts]).alias("e"))
    # Rows of one id, if there are several, lie in one task already.
    own = own.groupBy("node_id").agg(F.flatten(F.collect_list("e")).alias("e"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda t, x: t + x)
    at = F.array_distinct(F.transform("e", lambda x: x["pos"]))
    summed = own.select("node_id", F.transform(at, lambda p: F.struct(p.alias("pos"), total(F.transform(F.filter("e", lambda x: x["pos"] == p), lambda x: x["w"])).alias("w"))).alias("v"))
    norm = F.sqrt(total(F.transform("v", lambda x: x["w"] * x["w"])))
    return summed.withColumn("norm", norm).where("norm > 0").select("node_id", "norm", F.explode("v").alias("x")).select("node_id", "x.pos", (F.col("x.w") / F.col("norm")).alias("weight"))


def relationship_direction(a: str = "a", b: str = "b") -> Column:
    """1 if node ``a`` calls ``b``, -1 if ``b`` calls ``a``: the first rule that tells, else the order of ids.

    Works on rows with structs of ``node_id, name, category`` and, if known, ``n_ports``.
    """
    low = lambda x, c: F.lower(F.coalesce(F.col(f"{x}.{c}"), F.lit("")))
    ca, cb = low(a, "category"), low(b, "category")
    na, nb = F.lower(F.coalesce(f"{a}.name", f"{a}.node_id")), F.lower(F.coalesce(f"{b}.name", f"{b}.node_id"))
    has = lambda c, x: F.contains(c, F.lit(x))
    out = F
    for left, right in (("frontend", "backend"), ("backend", "database"), ("backend", "cache")):
        out = out.when(has(ca, left) & has(cb, right), 1).when(has(cb, left) & has(ca, right), -1)
    out = out.when(has(ca, "api") & ~has(cb, "api"), 1).when(has(cb, "api") & ~has(ca, "api"), -1)
    out = out.when(~has(ca, "queue") & has(cb, "queue"), 1).when(~has(cb, "queue") & has(ca, "queue"), -1)
    out = out.when(F.contains(nb, na) & has(na, "client"), 1).when(F.contains(na, nb) & has(nb, "client"), -1)
    pa, pb = F.coalesce(F.col(f"{a}.n_ports"), F.lit(0)) > 0, F.coalesce(F.col(f"{b}.n_ports"), F.lit(0)) > 0
    out = out.when(pa & ~pb, -1).when(pb & ~pa, 1)
    return out.otherwise(F.when(F.col(f"{a}.node_id") < F.col(f"{b}.node_id"), 1).otherwise(-1))


def _node(nodes: DataFrame) -> Column:
    ports = F.col("n_ports") if "n_ports" in nodes.columns else F.lit(0)
    return F.struct("node_id", "seq", "name", "category", ports.cast("int").alias("n_ports"))


def embedding_edges(nodes: DataFrame, vectors: DataFrame, threshold: float = 0.7, block_rows: int = 2_000) -> DataFrame:
    """An edge for each pair of nodes with a cosine above ``threshold``, in the direction of the ladder.

    ``vectors`` are sparse rows ``node_id, pos, weight`` of unit vectors. Places are ordered from the
    rarest to the most frequent, and a vector is found by its first places only: those without which
    the rest is shorter than ``threshold``, so that two vectors without one of them in common can't be
    alike enough. Pairs meet in the first such place that they share. What they share lies from there
    on, so the lengths that both have left bound their cosine; the others are held against each other
    whole, exactly. A place of many vectors is joined in blocks of ``block_rows``.
    """
    often = vectors.groupBy(F.col("pos").alias("__p")).agg(F.count("*").alias("__n"))
    rows = vectors.join(F.broadcast(often), F.col("pos") == F.col("__p"))  # one row per place, of which there are 64
    own = rows.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("__n", "pos", "weight"))).alias("v"))
    # What is left of the squared length from each place on; a place is needed while this reaches the threshold's square.
    left_of = lambda v, i: F.aggregate(F.slice(v, i + 1, F.size(v)), F.lit(0.0), lambda t, x: t + x["weight"] * x["weight"])
    needed = F.filter(F.transform("v", lambda x, i: F.struct(x["pos"].alias("pos"), left_of(F.col("v"), i).alias("left"))), lambda x: x["left"] > threshold * threshold - 1e-9)
    own = cut(own.select("node_id", needed.alias("first"), F.map_from_entries(F.transform("v", lambda x: F.struct(x["pos"], x["weight"]))).alias("w")))
    postings = own.select("node_id", F.transform("first", lambda x: x["pos"]).alias("places"), "w", F.explode("first").alias("f")).select("node_id", "places", "w", F.col("f.pos").alias("at"), F.col("f.left").alias("left"))
    met = pairs_in_blocks(postings, ["at"], "p", "q", "node_id", block_rows).where("p.node_id < q.node_id and p.left * q.left > " + repr(threshold * threshold - 1e-9))
    met = met.where(F.get(F.array_intersect("p.places", "q.places"), 0) == F.col("p.at"))
    product = F.aggregate(F.map_entries("p.w"), F.lit(0.0), lambda t, e: t + e["value"] * F.coalesce(F.try_element_at("q.w", e["key"]), F.lit(0.0)))
    cosine = met.select(F.col("p.node_id").alias("x"), F.col("q.node_id").alias("y"), product.alias("cosine")).where(F.col("cosine") > threshold)
    known = nodes.select(_node(nodes).alias("n"))
    pairs = cosine.join(known.select(F.col("n").alias("p")), F.col("x") == F.col("p.node_id")).join(known.select(F.col("n").alias("q")), F.col("y") == F.col("q.node_id"))
    first = F.col("p.seq") <= F.col("q.seq")
    pairs = pairs.withColumns({"a": F.when(first, F.col("p")).otherwise(F.col("q")), "b": F.when(first, F.col("q")).otherwise(F.col("p"))})
    forward = relationship_direction() == 1
    return pairs.select(
        F.when(forward, F.col("a.node_id")).otherwise(F.col("b.node_id")).alias("source"),
        F.when(forward, F.col("b.node_id")).otherwise(F.col("a.node_id")).alias("target"),
        F.lit("ml-inferred").alias("type"), F.col("cosine").alias("confidence"),
    )


def traffic_edges(nodes: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Edges between nodes of like request rates, the ratio of lesser to greater above 0.8, from the slower to the faster.

    Rates are dealt to logarithmic bands of that ratio; only neighbouring bands are joined.
    """
    import math

    rated = nodes.where("request_rate > 0 and latency_p95 is not null").select("node_id", "request_rate", "latency_p95", F.floor(F.log("request_rate") / -math.log(ratio)).alias("band"))
    left = rated.select(F.col("node_id").alias("source"), F.col("request_rate").alias("r1"), F.col("latency_p95").alias("l1"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = rated.select(F.col("node_id").alias("target"), F.col("request_rate").alias("r2"), F.col("latency_p95").alias("l2"), "band")
    alike = F.least("r1", "r2") / F.greatest("r1", "r2")
    pairs = left.join(right, "band").where((F.col("source") != F.col("target")) & (F.col("l1") > F.col("l2")) & (alike > ratio))
    return pairs.select("source", "target", F.lit("traffic-inferred").alias("type"), alike.alias("confidence"))


def error_edges(nodes: DataFrame, least: float = 0.05, block_rows: int = 2_000) -> DataFrame:
    """Edges from the node with the higher to the one with the lower error rate, of nodes above ``least``; all such pairs by definition, joined in blocks."""
    bad = nodes.where(F.col("error_rate") > least).select("node_id", "error_rate", F.lit(0).alias("all"))
    pairs = pairs_in_blocks(bad, ["all"], "a", "b", "node_id", block_rows).where("a.error_rate > b.error_rate")
    return pairs.select(F.col("a.node_id").alias("source"), F.col("b.node_id").alias("target"), F.lit("error-inferred").alias("type"), F.lit(0.7).alias("confidence"))


def deployment_edges(nodes: DataFrame, block_rows: int = 2_000) -> DataFrame:
    """Edges both ways between workloads of a namespace whose names begin with the same part; all such pairs by definition, joined in blocks."""
    space = F.when(F.contains("node_id", F.lit("/")), F.split_part("node_id", F.lit("/"), F.lit(1))).otherwise(F.lit("default"))
    rows = nodes.where(F.col("kind").isin(*WORKLOADS)).select("node_id", space.alias("ns"), F.split_part("name", F.lit("-"), F.lit(1)).alias("part"))
    pairs = pairs_in_blocks(rows, ["ns", "part"], "a", "b", "node_id", block_rows).where("a.node_id <> b.node_id")
    return pairs.select(F.col("a.node_id").alias("source"), F.col("b.node_id").alias("target"), F.lit("deployment-inferred").alias("type"), F.lit(0.6).alias("confidence"))


def prune_candidates(edges: DataFrame, cut: float = 0.8) -> DataFrame:
    """Edges with ``prune_candidate``: not direct, no more confident than ``cut``, and less than the edge the other way."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.coalesce("confidence", F.lit(0.0)).alias("__back"))
    own = F.coalesce("confidence", F.lit(0.0))
    flag = (own <= cut) & (F.coalesce("type", F.lit("")) != "direct") & (F.col("__back") > own)
    return edges.join(back, ["source", "target"], "left").withColumn("prune_candidate", F.coalesce(flag, F.lit(False))).drop("__back")


def enhance_graph(nodes: DataFrame, edges: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The edges and all inferred ones, merged: later steps give the type and confidence, and candidates for pruning are marked."""
    steps = [edges.select("source", "target", "type", "confidence"), embedding_edges(nodes, service_embedding(nodes), threshold), traffic_edges(nodes), error_edges(nodes), deployment_edges(nodes)]
    out = None
    for i, step in enumerate(steps):
        one = step.withColumn("emit_seq", F.lit(i).cast("long"))
        out = one if out is None else out.unionByName(one)
    return prune_candidates(merge_edges(out, nodes))
