import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from lantern.operators import checks, cycles, graph_algo, graph_build
from lantern.operators.components import connected_components, union_find
from lantern.sources import readers


def graph(spark, n, pairs):
    nodes = spark.createDataFrame([(f"n{i:02d}", i, f"n{i:02d}", "Service") for i in range(n)], "node_id string, seq long, name string, kind string")
    edges = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}") for a, b in pairs], "source string, target string")
    return nodes, edges


def parts(n, pairs, without=None):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    left, count = {i for i in range(n) if i != without}, 0
    while left:
        count += 1
        todo = [left.pop()]
        while todo:
            for y in near[todo.pop()]:
                if y in left:
                    left.discard(y)
                    todo.append(y)
    return count


@pytest.mark.parametrize("seed", range(4))
def test_articulation_points_by_deletion(spark, seed):
    rng = random.Random(seed)
    n = 14
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range([9, 13, 17, 24][seed])]
    found = {int(r["node_id"][1:]) for r in graph_algo.articulation_points(*graph(spark, n, pairs)).collect()}
    simple = [(a, b) for a, b in pairs if a != b]
    alone = {i for i in range(n)} - {x for p in simple for x in p}
    base = parts(n, simple)
    assert found == {i for i in range(n) if i not in alone and parts(n, simple, i) > base}


def test_barbell(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)]
    assert {r[0] for r in graph_algo.articulation_points(*graph(spark, 6, pairs)).collect()} == {"n02", "n03"}


def test_cycles_by_brute_force(spark):
    rng = random.Random(5)
    n = 7
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(20)}
    found = {tuple(r["nodes"]) for r in graph_algo.simple_cycles(graph(spark, n, pairs)[1], 4)[0].collect()}
    want = set()
    for k in (2, 3, 4):
        for p in itertools.permutations(range(n), k):
            if p[0] == min(p) and all((p[i], p[(i + 1) % k]) in pairs for i in range(k)):
                want.add(tuple(f"n{i:02d}" for i in p))
    assert found == want


@pytest.mark.parametrize("seed,most", [(1, 5_000_000), (2, 5_000_000), (3, 1)])
def test_components_of_unlisted_cycles(spark, seed, most):
    rng = random.Random(seed)
    # A ring of five, two rings of two with a common node, and two random parts.
    pairs = {(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (5, 6), (6, 5), (6, 7), (7, 6), (4, 5)}
    pairs |= {(rng.randrange(8, 13), rng.randrange(8, 13)) for _ in range(9)} | {(rng.randrange(13, 18), rng.randrange(13, 18)) for _ in range(7)}
    found = checks.all_circular_dependencies(graph(spark, 18, pairs)[1], 3, most).collect()
    rest = {tuple(int(x[1:]) for x in r["affected_nodes"]): int(r["metadata"]["listed_to"]) for r in found if "listed_to" in r["metadata"]}
    listed = 2 if most == 1 else 3
    cycles = [p for k in range(2, 6) for part in (range(5), range(5, 8), range(8, 13), range(13, 18)) for p in itertools.permutations(part, k) if p[0] == min(p) and all((p[i], p[(i + 1) % k]) in pairs for i in range(k))]
    assert {tuple(int(x[1:]) for x in r["affected_nodes"]) for r in found if "cycle_length" in r["metadata"]} == {p for p in cycles if len(p) <= listed}
    both = {(a, b) for a in range(18) for b in range(18) if any(a in p and b in p for p in cycles)}
    for k in range(18):
        both |= {(a, b) for a in range(18) for b in range(18) if (a, k) in both and (k, b) in both}
    assert rest == {tuple(b for b in range(18) if (p[0], b) in both): listed for p in cycles if len(p) > listed}
    assert (0, 1, 2, 3, 4) in rest and (5, 6, 7) not in rest


def test_detected_ring_of_five(spark):
    nodes, edges = graph(spark, 5, [(i, (i + 1) % 5) for i in range(5)])
    none = "cast(map() as map<string,string>)"
    issues = checks.detect_issues(nodes.selectExpr("*", "cast(null as string) as category", f"{none} as attrs_str", f"{none} as attrs_json"), edges)
    assert [len(r["affected_nodes"]) for r in issues.where("type = 'circular_dependency'").collect()] == [5]


def test_components_by_union_find(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert found == union_find([a for a, _ in pairs], [b for _, b in pairs])


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_reachability_and_paths(spark):
    _, edges = graph(spark, 6, [(0, 1), (1, 2), (2, 0), (2, 3), (4, 5)])
    roots = spark.createDataFrame([("n00",), ("n04",)], "node_id string")
    reached = graph_algo.reachability(edges, roots)
    assert {(r["root"], r["node_id"], r["dist"]) for r in reached.collect()} == {("n00", "n01", 1), ("n00", "n02", 2), ("n00", "n00", 3), ("n00", "n03", 3), ("n04", "n05", 1)}
    paths = {(r["root"], r["node_id"]): r["path"] for r in graph_algo.shortest_paths(reached).collect()}
    assert paths[("n00", "n03")] == ["n00", "n01", "n02", "n03"]


MANIFEST = """
apiVersion: v1
kind: Service
metadata: {name: user-service}
spec: {selector: {app: user}}
---
apiVersion: apps/v1
kind: Deployment
metadata: {name: frontend}
spec: {template: {spec: {containers: [{name: c, image: nginx, env: [{name: USER_SERVICE_URL, value: "http://user-service:80"}]}]}}}
---
apiVersion: apps/v1
kind: Deployment
metadata: {name: backend}
spec: {template: {spec: {containers: [{name: c, image: own, env: [{name: USER_SERVICE_HOST, value: "http://user-service"}]}]}}}
---
apiVersion: networking.k8s.io/v1
kind: Ingress
metadata: {name: ingress}
spec: {rules: [{http: {paths: [{path: /, backend: {service: {name: frontend, port: {number: 80}}}}]}}]}
"""


def test_four_documents(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(MANIFEST)
    (tmp_path / "bad.yml").write_text("a: [1")
    documents, bad = readers.read_manifests(spark, str(tmp_path))
    resources = graph_build.parse_manifests(documents)
    nodes = graph_build.build_nodes(resources.drop("labels"))
    found = graph_build.texts(resources)
    edges = graph_build.url_dependencies(found, nodes).unionByName(graph_build.env_name_dependencies(resources, nodes).selectExpr("source", "target", "type", "emit_seq + 1 as emit_seq"))
    edges = edges.unionByName(graph_build.ingress_edges(resources).select("source", "target", "type", "emit_seq"))
    merged = graph_build.merge_edges(edges, nodes)
    assert {(r["source"], r["target"], r["type"]) for r in merged.collect()} == {
        ("default/frontend", "default/user-service", "implied-dependency"), ("default/backend", "default/user-service", "implied-dependency"), ("default/ingress", "default/frontend", "ingress-route"),
    }
    assert [r["file"].endswith("bad.yml") for r in bad.collect()] == [True]
    none = "cast(map() as map<string,string>)"
    issues = checks.detect_issues(nodes.selectExpr("*", "cast(null as string) as category", f"{none} as attrs_str", f"{none} as attrs_json"), merged)
    counts = defaultdict(int)
    for r in issues.collect():
        counts[r["type"]] += 1
    assert counts == {"single_point_of_failure": 2, "missing_health_check": 3, "missing_autoscaling": 3}


def test_partitions_in_bounded_pieces(spark):
    nodes, edges = graph(spark, 90, [(i, i + 1) for i in range(59)] + [(70, 71), (71, 72)])
    whole = {r["metadata"]["component_index"]: r for r in checks.network_partitions(nodes, edges).collect()}
    pieces = checks.network_partitions(nodes, edges, most=10).collect()
    # A chain of 60, one of 3, and 27 nodes alone.
    assert len(whole) == 29 and all("piece" not in r["metadata"] for r in whole.values())
    for index, one in whole.items():
        own = [r for r in pieces if r["metadata"]["component_index"] == index]
        assert sorted(x for r in own for x in r["affected_nodes"]) == sorted(one["affected_nodes"])
        assert {r["description"] for r in own} == {one["description"]}
        split = len(one["affected_nodes"]) > 10
        assert all(("piece" in r["metadata"]) == split for r in own) and (len(own) > 1) == split
    assert checks.network_partitions(*graph(spark, 3, [(0, 1), (1, 2)])).count() == 0


def test_self_loop_is_no_orphan(spark):
    nodes, edges = graph(spark, 3, [(0, 0)])
    assert {r["affected_nodes"][0] for r in checks.orphaned_services(nodes, edges).collect()} == {"n01", "n02"}


def test_reach_counts(spark):
    """Counts of a random graph with cycles, a chain and a lone node, against a search from every node."""
    rng = np.random.default_rng(3)
    pairs = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 30, size=(38, 2)).tolist()} | {("c0", "c1"), ("c1", "c2"), ("c2", "c3"), ("n1", "c0")}
    names = sorted({x for p in pairs for x in p} | {"lone"})
    reach = {}
    for root in names:
        seen, todo = set(), [root]
        while todo:
            at = todo.pop()
            new = {b for a, b in pairs if a == at} - seen
            seen |= new
            todo += new
        reach[root] = seen - {root}
    nodes = spark.createDataFrame([(n,) for n in names], "node_id string")
    found = {r["node_id"]: (r["reached"], r["reaching"]) for r in graph_algo.reach_counts(nodes, spark.createDataFrame(sorted(pairs), "source string, target string")).collect()}
    assert found == {n: (len(reach[n]), sum(n in own for own in reach.values())) for n in names}


def rings(pairs, nodes):
    """All simple cycles by plain search, each from its least node."""
    out = {a: sorted(b for x, b in pairs if x == a and a != b) for a in nodes}
    found = []

    def walk(path):
        for b in out[path[-1]]:
            if b == path[0]:
                found.append(tuple(path))
            elif b > path[0] and b not in path:
                walk([*path, b])

    for a in nodes:
        walk([a])
    return [p for p in found if len(p) > 1]


@pytest.mark.parametrize("seed,n,m", [(1, 9, 24), (2, 12, 26), (3, 7, 42), (4, 14, 22)])
def test_cycles_of_any_length_by_brute_force(spark, seed, n, m):
    rng = random.Random(seed)
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(n, n + 1), (n + 1, n), (n + 1, n + 2)}
    want = sorted(tuple(f"n{i:02d}" for i in p) for p in rings(pairs, range(n + 3)))
    edges = graph(spark, n + 3, pairs)[1]
    found, members, rest = cycles.list_cycles(edges)
    assert sorted(tuple(r["nodes"]) for r in found.collect()) == want and members.isEmpty() and rest.isEmpty()


def test_dense_cycles_end_by_a_reported_bound(spark):
    """Eight nodes that all call each other, and a ring: each first edge lists its cycles, and only what was not listed whole is reported."""
    pairs = [(a, b) for a in range(8) for b in range(8) if a != b] + [(8, 9), (9, 10), (10, 8)]
    edges = graph(spark, 11, pairs)[1]
    every = [tuple(f"n{i:02d}" for i in p) for p in rings(pairs, range(11))]
    starts = {p[:2]: sum(q[:2] == p[:2] for q in every) for p in every}
    for most in (1_957, 1_956):
        found, members, _ = cycles.list_cycles(edges, most)
        rows = [tuple(r["nodes"]) for r in found.collect()]
        assert len(rows) == len(set(rows)) == sum(min(n, most) for n in starts.values()) and set(rows) <= set(every)
        assert [r["members"] for r in members.collect()] == ([[f"n{i:02d}" for i in range(8)]] if max(starts.values()) > most else [])
    text = [r["description"] for r in checks.all_circular_dependencies(edges, most=20).collect() if "listed_per_edge" in r["metadata"]]
    assert text == ["Circular dependency detected: more than 20 cycles from one edge among 8 services: " + ", ".join(f"n{i:02d}" for i in range(8))]


def test_large_components_are_searched_by_joins(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (1, 0), (3, 4), (4, 3)]
    found, members, rest = cycles.list_cycles(graph(spark, 5, pairs)[1], most_edges=2)
    assert [r["nodes"] for r in found.collect()] == [["n03", "n04"]] and members.isEmpty()
    assert {tuple(r["nodes"]) for r in graph_algo.simple_cycles(rest)[0].collect()} == {("n00", "n01"), ("n00", "n01", "n02")}


def test_no_cycles(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert [x.count() for x in cycles.list_cycles(none)] == [0, 0, 0]
    odd = spark.createDataFrame([("a", "a"), ("a", None), (None, "b"), ("a", "b"), ("a", "b")], "source string, target string")
    assert checks.all_circular_dependencies(odd).count() == 0


def test_blocks_of_a_forest_joined_in_rounds(spark):
    """A sparse graph of several trees and rings, against deletion of each node; no edges are joined by one task."""
    rng = random.Random(1)
    n = 14
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(13)]
    found = {int(r["node_id"][1:]) for r in graph_algo.articulation_points(*graph(spark, n, pairs), most=0).collect()}
    simple = [(a, b) for a, b in pairs if a != b]
    alone = set(range(n)) - {x for p in simple for x in p}
    base = parts(n, simple)
    assert found == {i for i in range(n) if i not in alone and parts(n, simple, i) > base}


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    """5,000 nodes in a row, a ring at its end: the cuts grow with the logarithm, not with the depth."""
    n, calls = 5_000, []
    plain = graph_algo.cut
    monkeypatch.setattr(graph_algo, "cut", lambda df: calls.append(1) or plain(df))
    pairs = [(f"p{i:05d}", f"p{i + 1:05d}") for i in range(n - 1)] + [(f"p{n - 1:05d}", f"p{n - 4:05d}")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    nodes = edges.selectExpr("source as node_id").union(edges.selectExpr("target")).distinct()
    found = sorted(r[0] for r in graph_algo.articulation_points(nodes, edges).collect())
    assert found == [f"p{i:05d}" for i in range(1, n - 3)] and len(calls) < 120


def test_shallow_trees_need_no_walk(spark, monkeypatch):
    """Stars under a root, a lone pair and a ring with a tail: leaves settle the trees, and only the ring is walked around."""
    calls, plain = [], graph_algo.cut
    monkeypatch.setattr(graph_algo, "cut", lambda df: calls.append(1) or plain(df))
    stars = [(0, i) for i in range(1, 6)] + [(1 + i % 5, 6 + i) for i in range(40)] + [(50, 51)]
    found = {int(r[0][1:]) for r in graph_algo.articulation_points(*graph(spark, 60, stars)).collect()}
    assert found == set(range(6)) and len(calls) <= 7
    ring = stars + [(52, 53), (53, 54), (54, 52), (54, 55), (55, 56)]
    assert {int(r[0][1:]) for r in graph_algo.articulation_points(*graph(spark, 60, ring)).collect()} == {*range(6), 54, 55}


def test_walk_around_trees(spark):
    """Places of a subtree lie between its root's two, without gaps over all trees."""
    pairs = [("a", "b"), ("a", "c"), ("c", "d"), ("c", "e"), ("x", "y")]
    rows = graph_algo.euler_tour(graph_algo.spanning_forest(spark.createDataFrame(pairs, "u string, v string"))).collect()
    at = {r["child"]: (r["first"], r["last"]) for r in rows}
    assert sorted(p for pair in at.values() for p in pair) == list(range(1, 11))
    assert len(rows) == 5 and {frozenset((r["child"], r["parent"])) for r in rows} == {frozenset(p) for p in pairs}
    for r in rows:
        if r["parent"] in at:
            assert at[r["parent"]][0] < at[r["child"]][0] < at[r["child"]][1] < at[r["parent"]][1]


def test_reach_counts_of_many_nodes(spark):
    """More nodes than a row of bits holds: a chain into a hub with a ring, and leaves of the hub."""
    pairs = [(i, i + 1) for i in range(10)] + [(10, 11), (11, 10)] + [(11, i) for i in range(12, 190)]
    nodes, edges = graph(spark, 191, pairs)
    found = {int(r["node_id"][1:]): (r["reached"], r["reaching"]) for r in graph_algo.reach_counts(nodes, edges).collect()}
    want = {i: (189 - i, i) for i in range(10)} | {10: (179, 11), 11: (179, 11)} | {i: (0, 12) for i in range(12, 190)} | {190: (0, 0)}
    assert found == want


@pytest.mark.parametrize("seed", range(2))
def test_propagation_paths_by_plain_search(spark, seed):
    """Every node of the shortest paths once, at its first place, problems in order, of equal parents the least."""
    from lantern.operators import rootcause

    rng = random.Random(seed)
    n = 12
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(22)}
    name = "n{:02d}".format
    problems = sorted(rng.sample(range(n), 4))
    into = {b: [a for a, x in pairs if x == b] for b in range(n)}
    want: dict = {}
    for root in problems:
        up, level, seen = {}, [root], {root}
        while level:
            later = sorted({a for b in level for a in into[b]} - seen)
            for a in later:
                up[a] = min(b for b in level if a in into[b])
            seen |= set(later)
            level = later
        for a in up:
            path = [a]
            while path[-1] != root:
                path.append(up[path[-1]])
            want.setdefault(name(a), []).extend(name(x) for x in path)
    want = {a: list(dict.fromkeys(p)) for a, p in want.items()}
    roots = spark.createDataFrame([(name(x),) for x in problems], "node_id string")
    found = {r["node_id"]: r["path"] for r in rootcause.propagation_paths(graph(spark, n, pairs)[1], roots).collect()}
    assert found == want


def test_leaves_go_over_repeated_edges_without_pairs(spark, monkeypatch):
    """Leaves under repeated edges both ways are told by their least and greatest neighbour: no frame of distinct pairs is made of a graph of stars."""
    monkeypatch.setattr(graph_algo, "undirected", None)
    stars = [(0, 1), (0, 2), (1, 3), (3, 1), (1, 3), (1, 4), (2, 2), (5, 6), (6, 5), (7, 7)]
    nodes, edges = graph(spark, 9, stars)
    rest, rounds = graph_algo.without_leaves(edges)
    assert rest.isEmpty() and sorted(tuple(r) for r in rounds[0].collect() if r["u"] in ("n03", "n05")) == [("n03", "n01", "n01"), ("n05", "n06", None)]
    rows = checks.single_points_of_failure(nodes, edges).collect()
    degrees = {r["affected_nodes"][0]: (r["metadata"]["incoming_connections"], r["metadata"]["outgoing_connections"]) for r in rows}
    assert degrees == {"n00": ("0", "2"), "n01": ("2", "2")}


@pytest.mark.parametrize("most", [0, 200_000])
def test_leaves_with_many_hubs(spark, most):
    """Looked up or dealt by both ends, the same edges are left: those of a ring, whose leaves and tail go."""
    ring = [(i, (i + 1) % 6) for i in range(6)] + [(i, 10 + 2 * i + j) for i in range(6) for j in range(2)] + [(30, 31), (31, 5), (5, 31)]
    rest, _ = graph_algo.without_leaves(graph(spark, 40, ring)[1], most=most)
    assert sorted((int(r[0][1:]), int(r[1][1:])) for r in rest.collect()) == sorted(ring[:6])


def test_weak_components_of_trees_need_no_labels(spark, monkeypatch):
    """Stars under a root, a lone pair, loops and a node that no table has: leaves take their hub's name, and the least node names each component."""
    monkeypatch.setattr(graph_algo, "connected_components", None)
    pairs = [(9, i) for i in range(3, 9)] + [(3, 20), (21, 3), (3, 21), (4, 1), (30, 31), (31, 30), (32, 32), (50, 40), (50, 41)]
    nodes, edges = graph(spark, 45, pairs)
    found = {int(r["node_id"][1:]): int(r["component"][1:]) for r in graph_algo.weak_components(nodes, edges).collect()}
    known = union_find([a for a, _ in pairs], [b for _, b in pairs])
    assert found == {i: known.get(i, i) for i in range(45)}


@pytest.mark.parametrize("seed", range(2))
def test_weak_components_by_union_find(spark, seed):
    """Rings with tails and stars, sparse and denser."""
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range([35, 60][seed])] + [(70, 71), (71, 72), (72, 70), (72, 73), (73, 74), (74, 69)]
    nodes, edges = graph(spark, 80, pairs)
    found = {int(r["node_id"][1:]): int(r["component"][1:]) for r in graph_algo.weak_components(nodes, edges).collect()}
    known = union_find([a for a, _ in pairs], [b for _, b in pairs])
    assert found == {i: known.get(i, i) for i in range(80)}


def test_resolved_issues_read_the_nodes_that_were_written(spark, small):
    """The resolutions' plan reads the nodes from where they were written, and makes them from no table again."""
    from lantern.plans.actions import r01

    files = r01(spark, small).inputFiles()
    assert files and not [f for f in files if f.endswith(("customer.parquet", "supplier.parquet"))]
