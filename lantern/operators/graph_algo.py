"""Graph algorithms as loops over joins: reachability, articulation points, cycles, ranks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.components import connected_components
from lantern.runtime import cut, in_order, lookup


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs both ways, without loops."""
    one = edges.where("source <> target").select(F.col("source").alias("u"), F.col("target").alias("v"))
    return one.union(one.select("v", "u")).distinct()


def weak_components(nodes: DataFrame, edges: DataFrame, bare: tuple[DataFrame, list[DataFrame]] | None = None) -> DataFrame:
    """``node_id, component``: the least node id of the component, for nodes without edges too; ``bare`` is what ``without_leaves`` gives of the edges.

    Labels are searched for among what is left without leaves; leaves then get their neighbour's, the last round's first, and a
    component is at last named by its least node.
    """
    rest, rounds = bare or without_leaves(edges)
    found = None if rest.isEmpty() else connected_components(rest, "source", "target")
    for leaves in reversed(rounds):
        if found is None:
            hung = leaves.select(F.col("u").alias("node"), F.coalesce("hub", F.least("u", "v")).alias("component"))
        else:
            over = found.select(F.col("node").alias("at"), F.col("component").alias("label"))
            hung = lookup(leaves, over, "v = at").select(F.col("u").alias("node"), F.coalesce("label", "hub", F.least("u", "v")).alias("component"))
            hung = hung.union(found)
        found = cut(hung)
    if found is None:
        return nodes.select("node_id", F.col("node_id").alias("component"))
    # A hub that lost all its edges has no label but itself.
    least = found.groupBy(F.col("component").alias("label")).agg(F.min("node").alias("first")).select("label", F.least("first", "label").alias("least"))
    placed = nodes.select("node_id").join(found, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("component", "node_id").alias("own"))
    return lookup(placed, cut(least), "own = label").select("node_id", F.coalesce("least", "own").alias("component"))


def reachability(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``root, node_id, dist, parent`` of all nodes that a root reaches in one step or more, by breadth-first rounds from all roots at once.

    ``parent`` is the least node before it on a shortest path. A root is among its own nodes only if a
    cycle returns to it. Rounds end when nothing new is met.
    """
    steps = edges.select("source", "target").distinct()
    start = roots.select(F.col("node_id").alias("root")).distinct()
    found = cut(start.join(steps, F.col("root") == F.col("source")).select("root", F.col("target").alias("node_id"), F.lit(1).alias("dist"), F.col("root").alias("parent")))
    frontier, depth = found, 1
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        near = frontier.join(steps, F.col("node_id") == F.col("source")).groupBy("root", "target").agg(F.min("source").alias("parent"))
        near = near.select("root", F.col("target").alias("node_id"), F.lit(depth).alias("dist"), "parent")
        frontier = cut(near.join(found.select("root", "node_id"), ["root", "node_id"], "left_anti"))
        found = found.union(frontier)
        if depth % 4 == 0:
            found = cut(found)
    return found


def _reach_sets(steps: DataFrame, own: DataFrame) -> DataFrame:
    """``part, word, bits``: the numbers of all nodes that a place reaches, its own included, 64 of them a row."""
    known = frontier = own
    while not frontier.isEmpty():
        met = frontier.withColumnRenamed("part", "target").join(steps, "target").groupBy(F.col("source").alias("part"), "word").agg(F.bit_or("bits").alias("bits"))
        before = known.select(F.col("part").alias("p"), F.col("word").alias("w"), F.col("bits").alias("had"))
        fresh = met.join(before, (F.col("part") == F.col("p")) & (F.col("word") == F.col("w")), "left")
        frontier = cut(fresh.select("part", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0"))
        known = cut(known.union(frontier).groupBy("part", "word").agg(F.bit_or("bits").alias("bits")))
    return known


def reach_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, reached, reaching``: the other nodes that a node reaches, and those that reach it.

    The nodes of a strong component reach the same, so each component is one place. What a place reaches
    is a set of bits, 64 consecutive numbers of nodes a row: numbers follow the component without
    directions and the name, so that nodes reached together lie in few rows. Sets are handed against
    the steps, only what is new each round, and with them for the second count; no row is a pair.
    """
    every = nodes.select("node_id").union(edges.select("source")).union(edges.select("target")).where("node_id is not null").distinct()
    parts = every.join(strong_components(edges), F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("component", "node_id").alias("part"))
    parts = cut(in_order(weak_components(parts, edges).join(parts, "node_id"), "component", "part", "node_id", name="number"))
    of = lambda column: parts.select(F.col("node_id").alias(column), F.col("part").alias(f"{column}_part"))
    steps = edges.join(of("source"), "source").join(of("target"), "target").where("source_part <> target_part")
    steps = cut(steps.select(F.col("source_part").alias("source"), F.col("target_part").alias("target")).distinct())
    bit = F.expr("shiftleft(1L, cast(number % 64 as int))")
    own = cut(parts.groupBy("part", F.floor(F.col("number") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")))
    count = lambda sets, name: sets.groupBy("part").agg((F.sum(F.bit_count("bits")) - 1).alias(name))
    reached = count(_reach_sets(steps, own), "reached")
    reaching = count(_reach_sets(steps.select(F.col("target").alias("source"), F.col("source").alias("target")), own), "reaching")
    return parts.join(reached, "part").join(reaching, "part").select("node_id", "reached", "reaching")


def shortest_paths(reached: DataFrame) -> DataFrame:
    """``root, node_id, dist, path``: the nodes of one shortest path, both ends included, from the parents that ``reachability`` keeps."""
    parents = reached.select("root", F.col("node_id").alias("__n"), F.col("parent").alias("__p"))
    rows = reached.withColumn("path", F.array("node_id")).withColumn("at", F.col("parent"))
    done = None
    while True:
        ended = rows.where("at = root").select("root", "node_id", "dist", F.concat(F.array("root"), "path").alias("path"))
        done = ended if done is None else done.union(ended)
        rows = rows.where("at <> root")
        rows = cut(rows.alias("r").join(parents.alias("p"), F.expr("r.root = p.root and r.at = p.__n")).select("r.root", "r.node_id", "r.dist", F.concat(F.array("r.at"), "r.path").alias("path"), F.col("p.__p").alias("at")))
        if rows.isEmpty():
            return done


def _joins(parent: dict, pdf: pd.DataFrame) -> list[bool]:
    """Whether each edge joins what those before it, and ``parent``, have not joined."""
    keep = []
    for a, b in zip(pdf["u"], pdf["v"], strict=True):
        ends = []
        for x in (a, b):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            ends.append(x)
        keep.append(ends[0] != ends[1])
        parent[max(ends)] = min(ends)
    return keep


def _forest_edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pdf[_joins({}, pdf)]


def _whole_forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}
    kept = [pdf[_joins(parent, pdf)] for pdf in frames]
    for pdf in kept:
        roots = []
        for x in pdf["u"]:
            while parent[x] != x:
                x = parent[x]
            roots.append(x)
        yield pdf.assign(tree=roots)


def spanning_forest(pairs: DataFrame, most: int = 200_000) -> DataFrame:
    """``u, v, tree``: the edges of a spanning forest of distinct ``pairs`` with u < v, and the name of their tree.

    A batch's superfluous edges go first; up to ``most`` edges are then joined by one task. Beyond that,
    each round every tree takes the least of its edges to
    others, by a hash, and the trees that are so joined become one, found by pointers that double their
    steps: the rounds grow with the logarithm of the nodes, whatever the depth.
    """
    kind = pairs.schema["u"].dataType.simpleString()
    near = cut(pairs.mapInPandas(_forest_edges, f"u {kind}, v {kind}"))
    if near.limit(most + 1).count() <= most:
        return cut(near.coalesce(1).mapInPandas(_whole_forest, f"u {kind}, v {kind}, tree {kind}"))
    links = cut(near.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct(F.xxhash64("u", "v").alias("w"), "u", "v").alias("e")))
    forest, names = None, None
    while not links.isEmpty():
        ways = links.union(links.select("b", "a", "e"))
        taken = cut(ways.groupBy("a").agg(F.min(F.struct("e", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.e").alias("e")))
        new = taken.select("e.u", "e.v").distinct()
        forest = new if forest is None else forest.union(new)
        # Both ends of a tree's least edge may take it; the lesser one is then the root.
        back = taken.select(F.col("a").alias("ba"), F.col("b").alias("bb"))
        up = cut(lookup(taken, back, "b = ba").select(F.col("a").alias("at"), F.when((F.col("bb") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("up")))
        while True:
            far = up.select(F.col("at").alias("mid"), F.col("up").alias("far"))
            grown = cut(lookup(up, far, "up = mid").select("at", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")))
            up = grown.select("at", "up")
            if grown.where("moved").isEmpty():
                break
        of = lambda one, root: up.select(F.col("at").alias(one), F.col("up").alias(root))
        names = up if names is None else cut(lookup(names, of("mid", "far"), "up = mid").select("at", F.coalesce("far", "up").alias("up")))
        moved = lookup(lookup(links, of("ax", "ra"), "a = ax"), of("bx", "rb"), "b = bx").where("ra <> rb")
        links = cut(moved.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("e").alias("e")))
    if forest is None:
        return pairs.select("u", "v", F.col("u").alias("tree")).limit(0)
    return cut(lookup(forest, names, "u = at").select("u", "v", F.col("up").alias("tree")))


def euler_tour(forest: DataFrame) -> DataFrame:
    """``child, parent, first, last``: each tree edge by its lower end, with the places at which a walk around its tree goes down and comes back.

    The walk leaves a node by the neighbour after the one that it came from, and starts at the tree's
    first arc in order. Arcs are ranked by pointers that double their steps. Places have no gaps over all trees,
    and those of a node's subtree lie between its own two.
    """
    arcs = forest.select("tree", F.col("u").alias("a"), F.col("v").alias("b")).union(forest.select("tree", "v", "u"))
    arcs = cut(in_order(arcs, "tree", "a", "b", name="i"))
    ends = arcs.groupBy("tree", "a").agg(F.min("i").alias("low"), F.max("i").alias("high"))
    head = arcs.groupBy(F.col("tree").alias("t")).agg(F.min("i").alias("head"), F.count("*").alias("n"))
    back = arcs.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("i").alias("j"))
    turned = arcs.join(back, (F.col("a") == F.col("y")) & (F.col("b") == F.col("x"))).join(ends.select(F.col("a").alias("at"), "low", "high"), F.col("b") == F.col("at"))
    after = turned.select("tree", "i", F.when(F.col("j") == F.col("high"), F.col("low")).otherwise(F.col("j") + 1).alias("next"))
    # The arc that would lead back to the head is a tree's last; its steps to the end are 0.
    ranks = cut(lookup(after, head, "tree = t").select("i", F.when(F.col("next") != F.col("head"), F.col("next")).alias("next")).withColumn("steps", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")))
    while not ranks.where("next is not null").isEmpty():
        far = ranks.select(F.col("i").alias("k"), F.col("next").alias("then"), F.col("steps").alias("more"))
        ranks = cut(ranks.join(far, F.col("next") == F.col("k"), "left").select("i", F.col("then").alias("next"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    placed = lookup(arcs.join(ranks.select("i", "steps"), "i"), head, "tree = t").select("a", "b", (F.col("head") + F.col("n") - 1 - F.col("steps")).alias("place"))
    edges = placed.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min(F.struct("place", "a", "b")).alias("down"), F.max("place").alias("last"))
    return edges.select(F.col("down.b").alias("child"), F.col("down.a").alias("parent"), F.col("down.place").alias("first"), "last")


def _extremes(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """``child, low, high``: the least ``lo`` and greatest ``hi`` of ``values`` (``place, lo, hi``) with a place in ``first``..``last`` of ``ranges``.

    Values of 2, 4, 8 ... consecutive places are made from those of half as many; a range is two of them.
    """
    asked = cut(ranges.select("child", "first", "last", F.floor(F.log2(F.col("last") - F.col("first") + 1) + 1e-9).cast("int").alias("level")))
    top = asked.agg(F.max("level")).first()[0]
    found, table = None, values
    for level in range((top or 0) + 1):
        if level:
            half = 1 << (level - 1)
            table = cut(table.select(F.explode(F.array("place", F.col("place") - half)).alias("place"), "lo", "hi").groupBy("place").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        here = asked.where(F.col("level") == level).select("child", F.explode(F.array("first", F.col("last") - (1 << level) + 1)).alias("place"))
        one = here.join(table, "place").groupBy("child").agg(F.min("lo").alias("low"), F.max("hi").alias("high"))
        found = one if found is None else found.union(one)
    return found


def without_leaves(edges: DataFrame, least: float = 0.25, most: int = 200_000) -> tuple[DataFrame, list[DataFrame]]:
    """The edges that are left when nodes with one neighbour are taken off round by round, without directions and loops; and each round's ``u, v, hub``.

    ``u`` is a leaf, ``v`` its neighbour, and ``hub`` that one again if it has others, or null for a lone pair. A leaf's
    least neighbour is its greatest, so repeated edges need no shuffle of their own. Nodes that stay are looked up through a broadcast
    up to ``most`` of them. A round that takes less than the share ``least`` of the nodes is the last, so the rounds grow
    with the logarithm of the nodes.
    """
    rest, rounds = edges.where("source <> target").select("source", "target"), []
    while True:
        ways = F.explode(F.array(F.struct(F.col("source").alias("u"), F.col("target").alias("v")), F.struct(F.col("target").alias("u"), F.col("source").alias("v"))))
        ends = cut(rest.select(ways.alias("w")).groupBy("w.u").agg(F.min("w.v").alias("v"), F.max("w.v").alias("last")))
        n = ends.agg(F.count("*").alias("all"), F.count_if(F.col("v") < F.col("last")).alias("hubs")).first()
        if n["hubs"] == n["all"]:
            return rest, rounds
        leaves, hubs = ends.where("v = last").select("u", "v"), ends.where("v < last").select(F.col("u").alias("hub"))
        few = F.broadcast(hubs) if n["hubs"] <= most else hubs
        rounds.append(leaves.join(few, F.col("v") == F.col("hub"), "left"))
        if not n["hubs"]:
            return rest.limit(0), rounds
        if n["hubs"] <= most:
            rest = rest.join(few, F.col("source") == F.col("hub"), "left_semi").join(few, F.col("target") == F.col("hub"), "left_semi")
        else:
            # By both ends, so that a node with many leaves is no hot key.
            rest = rest.join(leaves.union(leaves.select("v", "u")).toDF("source", "target"), ["source", "target"], "left_anti")
        rest = cut(rest)
        if n["hubs"] > (1 - least) * n["all"]:
            return rest, rounds


def articulation_points(nodes: DataFrame, edges: DataFrame, most: int = 200_000, bare: tuple[DataFrame, list[DataFrame]] | None = None) -> DataFrame:
    """``node_id`` of the nodes whose removal parts their component; ``bare`` is what ``without_leaves`` gives of the edges.

    Leaves go first, which is all that there is to do in shallow trees: a neighbour of a leaf that has others parts them. The rest
    works on any spanning forest. Two tree edges, each named by its lower end, are in one biconnected
    block when a chain of fundamental cycles joins them; enough of that relation is given by two kinds of
    pairs: the ends of an edge outside the forest of which none is above the other, and a tree edge with the one above it if an edge
    from below leads out of the upper end's subtree. What is below a node is told by its places on a walk
    around the tree, and how far its edges lead by extremes over these places; so all rounds grow with
    the logarithm of the nodes (``most`` is that of ``spanning_forest``). A node is an articulation point if its tree edges are in two blocks or more.
    """
    rest, rounds = bare or without_leaves(edges)
    parting = edges.select(F.col("source").alias("node_id")).limit(0)
    for leaves in rounds:
        parting = parting.union(leaves.where("hub is not null").select("hub").distinct())
    if rest.isEmpty():
        return parting.distinct()
    pairs = cut(undirected(rest)).where("u < v")
    forest = spanning_forest(pairs, most)
    tour = cut(euler_tour(forest))
    # A root is not below any edge: it has a place before, and none after, all of its tree.
    span = tour.select(F.col("child").alias("n"), F.col("first").alias("f"), F.col("last").alias("l"))
    extra = cut(pairs.join(forest.select("u", "v"), ["u", "v"], "left_anti"))
    of = lambda end: span.select(F.col("n").alias(end), F.col("f").alias(f"{end}f"), F.col("l").alias(f"{end}l"))
    placed = cut(extra.join(of("u"), "u", "left").join(of("v"), "v", "left"))
    reach = placed.select(F.col("uf").alias("place"), F.coalesce("vf", F.lit(-1)).alias("to")).union(placed.select("vf", F.coalesce("uf", F.lit(-1)))).where("place is not null")
    own = tour.select(F.col("first").alias("place"), F.col("first").alias("to"))
    values = cut(reach.union(own).groupBy("place").agg(F.min("to").alias("lo"), F.max("to").alias("hi")))
    far = _extremes(values, tour)
    above = lookup(tour.select("child", "parent"), span, "parent = n", how="inner").join(far, "child")
    upward = above.where((F.col("low") < F.col("f")) | (F.col("high") > F.col("l"))).select(F.col("child").alias("a"), F.col("parent").alias("b"))
    aside = placed.where("uf is not null and vf is not null and (ul < vf or vl < uf)").select(F.col("u").alias("a"), F.col("v").alias("b"))
    same = connected_components(cut(upward.union(aside)), "a", "b")
    tree_edges = tour.select("child", "parent").join(same, F.col("child") == F.col("node"), "left").select("child", "parent", F.coalesce("component", "child").alias("block"))
    ends = tree_edges.select(F.col("child").alias("node_id"), "block").union(tree_edges.select("parent", "block"))
    return ends.groupBy("node_id").agg(F.countDistinct("block").alias("n")).where("n > 1").select("node_id").union(parting).distinct()


def cycle_search(edges: DataFrame, max_length: int | None = None, max_paths: int = 5_000_000) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """``nodes`` of every simple directed cycle of 2 to ``listed`` nodes, the open paths of one node more, the edges that may be in cycles, and ``listed``.

    Nodes without a way in or out can't be in a cycle and go first, round by round. Paths then grow
    from their least node, so each longer cycle begins with an open path. Without ``max_length`` the
    search ends when no path is open; more than ``max_paths`` open paths end it before.
    """
    live = cut(edges.where("source <> target").select("source", "target").distinct())
    while True:
        kept = cut(live.join(live.select(F.col("target").alias("s")), F.col("source") == F.col("s"), "left_semi").join(live.select(F.col("source").alias("t")), F.col("target") == F.col("t"), "left_semi"))
        before, after = live.count(), kept.count()
        live = kept
        if after == before:
            break
    step = live.select(F.col("source").alias("at"), F.col("target").alias("next"))
    paths = live.where("source < target").select(F.array("source", "target").alias("nodes"), F.col("target").alias("at"))
    found, length = None, 1
    while length == 1 or ((max_length is None or length < max_length) and 0 < open_paths <= max_paths):
        length += 1
        closing = paths.join(step, "at").where("next = nodes[0]").select("nodes")
        found = closing if found is None else found.union(closing)
        grown = paths.join(step, "at").where("next > nodes[0] and not array_contains(nodes, next)")
        paths = cut(grown.select(F.concat("nodes", F.array("next")).alias("nodes"), F.col("next").alias("at")))
        open_paths = paths.count()
    return cut(found), paths, live, length


def simple_cycles(edges: DataFrame, max_length: int | None = None, max_paths: int = 5_000_000) -> tuple[DataFrame, bool]:
    """``nodes`` of every simple directed cycle, or of those of 2 to ``max_length`` nodes, from its least node on; and whether longer ones may exist.

    The number of cycles grows exponentially with the length in the worst case: the bound is part of
    the result, and more than ``max_paths`` open paths end the search. ``unlisted_cycles`` tells where
    longer ones are.
    """
    found, paths, _, _ = cycle_search(edges, max_length, max_paths)
    return found, not paths.isEmpty()


def _on_ways(edges: DataFrame) -> DataFrame:
    """The edges of nodes that keep both an edge in and an edge out, the only ones that cycles can have."""
    rows = None
    while rows != 0:
        ends = F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(True).alias("out")), F.struct(F.col("target").alias("node"), F.lit(False).alias("out"))))
        both = edges.select(ends.alias("e")).groupBy("e.node").agg(F.bool_or("e.out").alias("out"), F.bool_or(~F.col("e.out")).alias("into"))
        both = cut(both.where("out and into").select("node"))
        edges = cut(lookup(lookup(edges, both, "source = node", how="left_semi"), both, "target = node", how="left_semi"))
        before, rows = rows, edges.count()
        if rows == before:
            break
    return edges


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes that are in a directed cycle with others.

    Nodes that nothing enters or leaves are taken off until none is left. Then each round gives every
    node the least node that reaches it; those that reach that one in turn, along nodes of the same
    least node, are its component and leave. Every round takes one at least.
    """
    left, done = _on_ways(edges.where("source <> target").select("source", "target")), None
    left = left if left.isEmpty() else cut(left.distinct())
    while not left.isEmpty():
        labels = cut(left.select(F.col("source").alias("node")).union(left.select("target")).distinct().withColumn("component", F.col("node")))
        while True:
            near = labels.join(left, F.col("node") == F.col("source")).groupBy(F.col("target").alias("n")).agg(F.min("component").alias("c"))
            after = cut(labels.join(near, F.col("node") == F.col("n"), "left").select("node", F.least("component", "c").alias("component"), (F.col("c") < F.col("component")).alias("changed")))
            labels = after.select("node", "component")
            if after.where("changed").isEmpty():
                break
        inside = left.join(labels.select(F.col("node").alias("source"), F.col("component").alias("c")), "source").join(labels.select(F.col("node").alias("target"), F.col("component").alias("d")), "target").where("c = d").select("source", "target")
        inside = cut(inside)
        frontier = taken = cut(labels.where("node = component"))
        while not frontier.isEmpty():
            back = frontier.join(inside, F.col("node") == F.col("target")).select(F.col("source").alias("node"), "component").distinct()
            frontier = cut(back.join(taken.select("node"), "node", "left_anti"))
            taken = cut(taken.union(frontier))
        done = taken if done is None else done.union(taken)
        gone = taken.select(F.col("node").alias("g"))
        left = _on_ways(cut(left.join(gone, F.col("source") == F.col("g"), "left_anti").join(gone, F.col("target") == F.col("g"), "left_anti")))
    if done is None:
        return edges.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0)
    several = done.groupBy(F.col("component").alias("c")).count().where("count > 1").select("c")
    return cut(done.join(several, F.col("component") == F.col("c"), "left_semi"))


def unlisted_cycles(paths: DataFrame, live: DataFrame) -> DataFrame:
    """``component, members`` of the strong components with a simple cycle that a ``cycle_search`` has not listed, exactly.

    A cycle with more nodes than listed begins with an open path and goes back to its start without the
    path's inner nodes; any way back is a simple one when shortened. So all ways back are followed at
    once, and a component leaves when one of its paths is closed.
    """
    parts = strong_components(live)
    of = lambda column, name: parts.select(F.col("node").alias(column), F.col("component").alias(name))
    step = cut(live.join(of("source", "c"), "source").join(of("target", "d"), "target").where("c = d").select(F.col("source").alias("at"), F.col("target").alias("next")))
    rows = paths.select(F.get("nodes", 0).alias("start"), F.array_sort(F.slice("nodes", F.lit(2), F.size("nodes") - 2)).alias("barred"), "at")
    rows = seen = cut(rows.join(of("start", "component"), "start").join(of("at", "d"), "at").where("component = d").select("component", "start", "barred", "at").distinct())
    proven = rows.select("component").limit(0)
    while not rows.isEmpty():
        ways = rows.join(step, "at")
        proven = cut(proven.union(ways.where("next = start").select("component")).distinct())
        new = ways.where("next > start and not array_contains(barred, next)").select("component", "start", "barred", F.col("next").alias("at")).distinct()
        rows = cut(new.join(proven, "component", "left_anti").join(seen, ["component", "start", "barred", "at"], "left_anti"))
        seen = cut(seen.union(rows))
    return parts.join(proven, "component", "left_semi").groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))


def degrees(nodes: DataFrame, edges: DataFrame, few: bool = False) -> DataFrame:
    """``node_id, in_degree, out_degree`` over distinct edges; a loop counts both ways. Ends of other nodes go before they are counted where the nodes are ``few`` of the graph's."""
    distinct = edges.select("source", "target").distinct()
    ends = distinct.select(F.col("source").alias("n"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(distinct.select("target", F.lit(1), F.lit(0)))
    if few:
        ends = lookup(ends, nodes.select("node_id").distinct(), "n = node_id", how="left_semi")
    sums = ends.groupBy("n").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return nodes.select("node_id").join(sums, F.col("node_id") == F.col("n"), "left").select("node_id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, clustering``: linked pairs of neighbours over all pairs, without directions.

    Each triangle is found once, from its edges pointed to the end of higher degree, which bounds the
    pairs that a hub gives.
    """
    both = undirected(edges)
    degree = both.groupBy(F.col("u").alias("n")).agg(F.count("*").alias("deg"))
    ranked = both.join(degree.select(F.col("n").alias("u"), F.col("deg").alias("du")), "u").join(degree.select(F.col("n").alias("v"), F.col("deg").alias("dv")), "v")
    out = cut(ranked.where("struct(du, u) < struct(dv, v)").select("u", "v"))
    wedge = out.select(F.col("u").alias("a"), F.col("v").alias("b")).join(out.select(F.col("u").alias("a"), F.col("v").alias("c")), "a").where("b <> c")
    closed = wedge.join(out.select(F.col("u").alias("b"), F.col("v").alias("c")), ["b", "c"])
    triangles = closed.select(F.explode(F.array("a", "b", "c")).alias("n")).groupBy("n").agg(F.count("*").alias("t"))
    joined = nodes.select("node_id").join(degree, F.col("node_id") == F.col("n"), "left").drop("n").join(triangles, F.col("node_id") == F.col("n"), "left")
    pairs = F.col("deg") * (F.col("deg") - 1)
    return joined.select("node_id", F.when(F.col("deg") > 1, 2.0 * F.coalesce("t", F.lit(0)) / pairs).otherwise(0.0).alias("clustering"))


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """``node_id, rank``: a fixed number of rounds; nodes without a way out share their rank with all.

    Nodes that nothing calls all have one rank, and what they give follows from it, so the rounds hold only the called nodes and the
    links among them; a called node gets what the others give it as a share of that rank, which is summed once.
    """
    steps = edges.select("source", "target").distinct()
    out = steps.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n"))
    links = cut(steps.join(out, F.col("source") == F.col("s")).select("source", "target", "n"))
    known = cut(nodes.select("node_id").join(links.select(F.col("source").alias("s"), "n").distinct(), F.col("node_id") == F.col("s"), "left").join(links.select(F.col("target").alias("t")).distinct(), F.col("node_id") == F.col("t"), "left"))
    called = F.col("t").isNotNull()
    counts = known.agg(F.count("*").alias("all"), F.count_if(~called & F.col("s").isNull()).alias("alone")).first()
    count, rest = counts["all"], 1.0 / max(1, counts["all"])
    at = lambda rows, name: rows.select(F.col("node_id").alias(name)).distinct()
    # What a called node gets from the uncalled, for a rank of theirs of 1.
    free = links.join(at(known.where(~called), "source"), "source", "left_semi").groupBy(F.col("target").alias("f")).agg(F.sum(1 / F.col("n")).alias("free"))
    inner = cut(known.where(called).join(free, F.col("node_id") == F.col("f"), "left").select("node_id", F.col("s").isNull().alias("ends"), F.coalesce("free", F.lit(0.0)).alias("free")))
    among = cut(links.join(at(inner, "source"), "source", "left_semi"))
    ranks = inner.withColumn("rank", F.lit(rest))
    for i in range(rounds):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("ends"), F.col("rank"))), F.lit(0.0))).first()[0] + counts["alone"] * rest
        base = (1 - damping) / max(1, count) + damping * lost / max(1, count)
        given = among.join(ranks.select(F.col("node_id").alias("source"), "rank"), "source").groupBy(F.col("target").alias("g")).agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        got = F.coalesce("got", F.lit(0.0)) + F.col("free") * F.lit(rest)
        ranks = cut(ranks.join(given, F.col("node_id") == F.col("g"), "left").select("node_id", "ends", "free", (F.lit(base) + damping * got).alias("rank")))
        rest = base
    return ranks.select("node_id", "rank").union(known.where(~called).select("node_id", F.lit(rest).alias("rank")))


def sequential_groups(events: DataFrame, key: str, ts: str, gap_seconds: int = 300) -> DataFrame:
    """``group_start``: events of a key in order, a new group when one is over ``gap_seconds`` after the group's first.

    A group's start tells the next one's: the first event that is over the gap later. So every time of
    a key points to the start after it, found among the times of the two buckets of the gap's width that
    follow, and the starts are those that the first time after a longer gap leads to. Pointers double
    their steps each round, so the rounds grow with the logarithm of the groups without a longer gap
    between them; times of a key are never gathered. A null key is a key; events without a time have no
    start.
    """
    from lantern.operators.logs import micros

    span = gap_seconds * 1_000_000
    rows = events.withColumn("__us", micros(F.col(ts))).withColumn("__key", F.struct(F.col(key).alias("k")))
    times = cut(rows.where("__us is not null").select("__key", F.col("__us").alias("t")).distinct().withColumn("b", F.floor(F.col("t") / span)))
    ends = times.groupBy("__key", "b").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    around = ends.withColumn("before", F.lag("last").over(Window.partitionBy("__key").orderBy("b")))
    # A time over the gap after the one before it always starts a group; within a bucket there is none.
    heads = around.where(F.coalesce(F.col("first") - F.col("before") > span, F.lit(True))).select("__key", F.col("first").alias("t"))
    # Asked: the first time after t + span, which lies in the next bucket or is the first of the one after.
    asked = times.select("__key", (F.col("b") + 1).alias("b"), (F.col("t") + span).alias("p"), F.lit(0).alias("is_time"), "t")
    targets = times.select("__key", "b", F.col("t").alias("p"), F.lit(1).alias("is_time"), "t")
    later = Window.partitionBy("__key", "b").orderBy("p", F.desc("is_time")).rowsBetween(1, Window.unboundedFollowing)
    near = asked.union(targets).withColumn("next", F.min(F.when(F.col("is_time") == 1, F.col("t"))).over(later)).where("is_time = 0")
    second = ends.select(F.col("__key").alias("__k2"), F.col("b").alias("b2"), F.col("first").alias("after"))
    jump = near.join(second, (F.col("__key") == F.col("__k2")) & (F.col("b") + 1 == F.col("b2")), "left").select("__key", "t", F.coalesce("next", "after").alias("next")).where("next is not null")
    jump, starts = cut(jump), cut(heads)
    while True:
        led = starts.join(jump, ["__key", "t"]).select("__key", F.col("next").alias("t"))
        grown = cut(starts.union(led).distinct())
        if grown.count() == starts.count():
            break
        starts = grown
        onward = jump.select(F.col("__key").alias("__k2"), F.col("t").alias("next2"), F.col("next").alias("then"))
        jump = cut(jump.join(onward, (F.col("__key") == F.col("__k2")) & (F.col("next") == F.col("next2"))).select("__key", "t", F.col("then").alias("next")))
    # There is one start in a bucket at most, so an event's is that of its own or of the bucket before.
    begun = starts.select(F.col("__key").alias("__k2"), F.col("t").alias("__start"), F.explode(F.array(F.floor(F.col("t") / span), F.floor(F.col("t") / span) + 1)).alias("__b2"))
    at = times.join(begun, (F.col("__key") == F.col("__k2")) & (F.col("b") == F.col("__b2")) & (F.col("__start") <= F.col("t")), "left")
    found = at.groupBy(F.col("__key").alias("__k3"), F.col("t").alias("__t3")).agg(F.max("__start").alias("__start"))
    joined = rows.join(found, (F.col("__key") == F.col("__k3")) & (F.col("__us") == F.col("__t3")), "left")
    return joined.select(*events.columns, F.timestamp_micros("__start").cast("timestamp_ntz").alias("group_start"))
