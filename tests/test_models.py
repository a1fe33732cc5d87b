"""Models, ranks and paths against small versions in numpy, and rows with nulls."""

import json
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lantern.operators import graph_algo as G
from lantern.operators import metrics as A
from lantern.operators import ml as T
from lantern.operators import rootcause as C
from lantern.operators import sketches as X
from lantern.runtime import in_cells, sum_before
from lantern.sources import readers as S
from lantern.sources import sinks


def brute_lof(x, k):
    """Against each other, nearest by distance, then by how near in place, then by place; x are rows in that order."""
    x = np.asarray(x, dtype=float).reshape(len(x), -1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    i = np.arange(len(x))
    near = np.array([np.lexsort((i, np.abs(i - j), d[j])) for j in i])[:, : min(k, len(x) - 1)]
    kd = np.take_along_axis(d, near, 1)[:, -1]
    reach = np.maximum(np.take_along_axis(d, near, 1), kd[near]).sum(1)
    density = np.where(reach > 0, near.shape[1] / np.where(reach > 0, reach, 1), np.inf)
    return np.array([1.0 if np.isinf(density[i]) else (density[near[i]] / density[i]).mean() for i in range(len(x))])


@pytest.mark.parametrize("cell_rows", [20_000, 130])
def test_lof_of_numbers(spark, cell_rows):
    rng = np.random.default_rng(3)
    series = {"a": rng.normal(size=700).round(2), None: rng.exponential(size=90), "one": np.array([5.0]), "same": np.full(30, 2.0)}
    rows = [(i, k, float(v)) for k, own in series.items() for i, v in enumerate(own)] + [(1000, "a", None), (1001, "a", float("nan"))]
    df = spark.createDataFrame(rows, "i long, key string, value double").repartition(5)
    found = defaultdict(dict)
    for r in T.lof_1d(df, ["key"], tie=["i"], k=20, cell_rows=cell_rows).collect():
        found[r["key"]][r["i"]] = r["lof"]
    assert sum(map(len, found.values())) == len(rows)
    assert found["a"].pop(1000) is None and found["a"].pop(1001) is None and found["one"][0] is None or math.isnan(found["one"][0])
    for key in ("a", None, "same"):
        order = sorted(range(len(series[key])), key=lambda i: (series[key][i], i))
        want = brute_lof(series[key][order], 20)
        assert np.allclose([found[key][i] for i in order], want)


def test_lof_of_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3))
    rows = [(i, None if i < 40 else "k", x[i].tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "i long, key string, v array<double>")
    found = {r["i"]: r["lof"] for r in T.local_outlier_factor(df, "key", F.col("v"), k=5).collect()}
    for own in (x[:40], x[40:]):
        d = np.sqrt(((own[:, None] - own[None]) ** 2).sum(-1))
        apart = d + np.where(np.eye(40) > 0, np.inf, 0)
        near = np.argsort(apart, axis=1)[:, :5]
        kd = np.take_along_axis(apart, near, 1)[:, -1]
        density = 1 / np.maximum(np.take_along_axis(apart, near, 1), kd[near]).mean(1)
        # Rows are scored as new ones, so a row of the training set is its own nearest.
        nearest = np.argsort(d, axis=1, kind="stable")[:, :5]
        want = density[nearest].mean(1) * np.maximum(np.take_along_axis(d, nearest, 1), kd[nearest]).mean(1)
        start = 0 if own is not x[40:] and np.array_equal(own, x[:40]) else 40
        assert np.allclose([found[start + i] for i in range(40)], want, rtol=1e-5)


def test_isolation_forest(spark):
    """Depths of one tree by hand, the score's formula, and planted outliers of a null and a named key."""
    trees = T.grow_trees(np.arange(16.0)[:, None], 1, trees=20, rows=16)
    x = np.array([[0.0], [7.3], [40.0]])
    depth = np.zeros(3)
    for t in trees:
        for i, own in enumerate(x):
            at = 0
            while t["column"][at] >= 0:
                at = t["left"][at] + int(own[t["column"][at]] >= t["value"][at])
            depth[i] += t["end"][at]
    expected = 2 * (np.log(15) + 0.5772156649) - 2 * 15 / 16
    assert np.allclose(T.isolation_scores(trees, x), 2.0 ** (-(depth / 20) / expected))
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 2 else "k", [float(v) for v in rng.normal(size=2)]) for i in range(400)] + [(400, None, [9.0, 9.0]), (401, "k", [-9.0, 9.0])]
    found = T.isolation_forest(spark.createDataFrame(rows, "i long, key string, v array<double>"), "key", F.col("v")).collect()
    best = sorted(found, key=lambda r: -r["iso_score"])[:2]
    assert len(found) == 402 and {r["i"] for r in best} == {400, 401}
    assert 0.02 <= sum(r["iso_outlier"] for r in found) / 402 <= 0.06


def test_reconstruction_error(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 6)) + rng.normal(size=(60, 6)) * 0.05
    x[7] += rng.normal(size=6) * 3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, features array<double>")
    found = {r["i"]: r for r in T.reconstruction_error(rows, components=2).collect()}
    c = x - x.mean(0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    want = np.linalg.norm(c - c @ v[:2].T @ v[:2], axis=1)
    assert np.allclose([found[i]["recon_error"] for i in range(60)], want, atol=1e-6) and found[7]["recon_outlier"]
    assert sum(r["recon_outlier"] for r in found.values()) == 3


def test_cluster_outlier_factor_keeps_rows_with_gaps(spark):
    values = [0.0, 0.1, 0.2] * 10 + [10.0, 10.1] * 10 + [55.0, None, float("nan")]
    found = {r["i"]: r["cblof"] for r in T.cluster_outlier_factor(spark.createDataFrame(list(enumerate(values)), "i long, v double"), ["v"]).collect()}
    assert len(found) == len(values) and found[51] is None and found[52] is None
    assert found[0] == pytest.approx(0.1) and found[30] == pytest.approx(0.05) and found[50] == pytest.approx(55 - 10.05)


def test_log_features(spark):
    """Few terms and rows, so the scaled weights themselves are the features."""
    lines = ["disk full", "disk slow", "disk full again", None]
    found = {r["i"]: r["features"] for r in T.log_features(spark.createDataFrame(list(enumerate(lines)), "i long, message string"), components=50).collect()}
    terms = [{"disk", "full", "disk full"}, {"disk", "slow", "disk slow"}, {"disk", "full", "disk full", "full again", "disk full again", "again"}]
    terms[2] = {"disk", "full", "disk full"} if len(found[0]) == 5 else terms[2]
    df = defaultdict(int)
    for own in terms:
        for t in own:
            df[t] += 1
    weight = {t: math.log(4 / (n + 1)) + 1 for t, n in df.items()}
    std = {t: np.std([weight[t] * (t in own) for own in terms], ddof=1) for t in df}
    for i, own in enumerate(terms):
        want = sorted(weight[t] / std[t] if std[t] > 0 else 0.0 for t in own)
        assert np.allclose(sorted(v for v in found[i] if v > 0), [v for v in want if v > 0])
    assert 3 not in found


def test_model_scores_of_log_lines(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(200, 4)) * 0.1, [[6.0, -6.0, 6.0, 6.0]]])
    rows = spark.createDataFrame([(i, "s", v.tolist()) for i, v in enumerate(x)], "seq long, service string, features array<double>").withColumn("ts", F.current_timestamp())
    scored = T.log_model_scores(rows, "service")
    by = {r["seq"]: r for r in scored.collect()}
    top = by[200]
    assert top["iso"] > 0.9 and top["lof"] > 0.9 and top["dbscan"] == 1.0
    assert sum(r["dbscan"] for r in by.values()) == 1 and 0 < sum(r["iso"] > 0 for r in by.values()) <= 11
    assert 5 <= sum(r["reconstruction"] > 0.5 for r in by.values()) <= 11 and 5 <= sum(r["lof"] > 0.7 for r in by.values()) <= 11
    found = {r["seq"]: r["score"] for r in T.ml_log_anomalies(scored, ["iso", "lof", "dbscan", "reconstruction"]).collect()}
    assert found == {i: pytest.approx(m) for i, r in by.items() if (m := max(r["iso"], r["lof"], r["dbscan"], r["reconstruction"])) > 0.7}


def test_page_rank(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node_id string")
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "e")]
    found = {r["node_id"]: r["rank"] for r in G.page_rank(nodes, spark.createDataFrame(pairs, "source string, target string")).collect()}
    rank = dict.fromkeys("abcde", 0.2)
    out = defaultdict(list)
    for s, t in pairs:
        out[s].append(t)
    for _ in range(30):
        lost = sum(rank[n] for n in rank if not out[n])
        new = {n: 0.15 / 5 + 0.85 * lost / 5 for n in rank}
        for s in out:
            for t in out[s]:
                new[t] += 0.85 * rank[s] / len(out[s])
        rank = new
    assert found == {n: pytest.approx(v, abs=1e-9) for n, v in rank.items()}


def test_fitted_q(spark):
    rows = [("s", "go", 1.0, "t"), ("s", "stay", 0.0, "s"), ("t", "go", 5.0, None), ("t", "stay", 1.0, "s"), ("s", "go", 3.0, "s")]
    found = {(r["state"], r["action"]): r["q"] for r in X.fitted_q(spark.createDataFrame(rows, "state string, action string, reward double, next_state string")).collect()}
    q = {(s, a): 0.0 for s, a, _, _ in rows}
    for _ in range(400):
        best = {s: max(v for (x, _), v in q.items() if x == s) for s in ("s", "t")}
        q = {k: np.mean([r + 0.9 * best.get(n, 0.0) for s, a, r, n in rows if (s, a) == k]) for k in q}
    assert found == {k: pytest.approx(v, abs=2e-3) for k, v in q.items()}


def test_propagation_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e")], "source string, target string")
    problems = spark.createDataFrame([("c",), ("e",)], "node_id string")
    found = {r["node_id"]: r["path"] for r in C.propagation_paths(edges, problems).collect()}
    assert found == {"a": ["a", "b", "c", "e"], "b": ["b", "c", "e"], "d": ["d", "c", "e"], "c": ["c", "e"]}


def test_root_cause_model_learns_what_later_records_show(spark):
    """A planted rule is learnt, and scores are probabilities above a tenth."""
    rng = np.random.default_rng(8)
    rows = [(f"n{i}", *[float(v) for v in rng.random(len(C.FEATURES))]) for i in range(400)]
    at = C.FEATURES.index("n_issues") + 1
    frame = spark.createDataFrame([(*r, int(r[at] > 0.6)) for r in rows], ["node_id", *C.FEATURES, "is_root_cause"])
    model, found = C.train_root_cause_model(frame)
    assert model.getNumTrees == 100 and model.getOrDefault("maxDepth") == 10 and min(found.values()) > 0.85
    scores = {r["node_id"]: r["score"] for r in C.ml_scores(model, frame).collect()}
    assert min(scores.values()) > 0.1 and np.mean([scores.get(r[0], 0.0) > 0.5 for r in rows if r[at] > 0.6]) > 0.95


def test_root_cause_forest_keeps_the_nodes_that_rows_reached(spark):
    """Its trees are those of a forest that walks from the roots at each level."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(9)
    rows = [(f"n{i}", *[float(v) for v in rng.random(len(C.FEATURES))], int(i % 3 == 0)) for i in range(200)]
    frame = spark.createDataFrame(rows, ["node_id", *C.FEATURES, "is_root_cause"]).coalesce(1)
    model, _ = C.train_root_cause_model(frame)
    assert model.getOrDefault("cacheNodeIds")
    whole = VectorAssembler(inputCols=list(C.FEATURES), outputCol="features").transform(frame.withColumn("label", F.col("is_root_cause").cast("double")))
    plain = RandomForestClassifier(numTrees=100, maxDepth=10, seed=42, cacheNodeIds=False).fit(whole.randomSplit([0.8, 0.2], 42)[0])
    assert model.toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1]


def test_null_keys_are_keys(spark):
    rows = [(i, None if i % 2 else "k", "m", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "i long, key string, other string, value double")
    found = A.standardise(df, ["key", "other"]).collect()
    assert len(found) == 20 and all(abs(sum(r["standardised"] for r in found if r["key"] == k)) < 1e-9 for k in (None, "k"))
    newest = A.training_window(df, ["key"], [F.desc("value")], most=4, least=10).collect()
    assert {(r["key"], r["i"]) for r in newest} == {(k, i) for k, top in ((None, 19), ("k", 18)) for i in range(top, top - 8, -2)}
    noise = T.dbscan_outliers(df, "key", F.array(F.col("value") / 10), eps=0.5, least=2).collect()
    assert len(noise) == 20 and not any(r["is_noise"] for r in noise)


def test_graph_documents_of_any_size(spark, tmp_path):
    n = 100_001
    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("node_id"), F.when(F.col("id") > 0, F.create_map(F.lit("kind"), F.lit("Pod"))).alias("attrs"))
    edges = spark.range(n).select(F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), (F.col("id") + 1) % n).alias("target"), F.create_map(F.lit("type"), F.lit("uses")).alias("attrs"))
    S.write_graph_json(nodes, edges, str(tmp_path / "lines"))
    there, linked = S.read_graph_json(spark, str(tmp_path / "lines"), lines=True)
    assert there.count() == n and linked.count() == n and linked.first()["attrs"] == {"type": "uses"}
    (tmp_path / "one.json").write_text(json.dumps({"nodes": [{"id": "a", "kind": "Pod"}, {"id": "b"}], "edges": [{"source": "a", "target": "b"}, {"source": "a", "target": "x"}]}, indent=1))
    there, linked = S.read_graph_json(spark, str(tmp_path / "one.json"))
    assert there.count() == 2 and [tuple(r)[:2] for r in linked.collect()] == [("a", "b")]


def test_temporal_groups(spark):
    rng = np.random.default_rng(9)
    rows = []
    for key in ("a", "b", None):
        at = 0
        for _ in range(300):
            at += int(rng.choice([0, 20, 90, 149, 151, 299, 300, 301, 700]))
            rows.append((key, 1_700_000_000 + at))
    df = spark.createDataFrame(rows, "key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    found = {(r["key"], r["s"]): r["g"] for r in X.temporal_groups(df, "key").select("key", "s", F.unix_timestamp(F.col("group_start").cast("timestamp")).alias("g")).collect()}
    want = {}
    for key in ("a", "b", None):
        start = None
        for s in sorted({s for k, s in rows if k == key}):
            start = s if start is None or s - start > 300 else start
            want[key, s] = start
    assert found == want


def test_cycles_of_any_length_are_reported(spark):
    from lantern.operators import checks as D

    ring = [(f"r{i}", f"r{(i + 1) % 6}") for i in range(6)] + [("x", "y"), ("y", "x")]
    edges = spark.createDataFrame(ring, "source string, target string")
    want = [("r0", "r1", "r2", "r3", "r4", "r5"), ("x", "y")]
    for bound, links in ((None, 6), (4, 0)):
        found = D.all_circular_dependencies(edges, bound).collect()
        assert sorted(tuple(r["affected_nodes"]) for r in found) == want
        assert max(len(r["affected_edges"]) for r in found if len(r["affected_nodes"]) == 6) == links


def test_weakest_edge_over_all_paths(spark):
    from lantern.operators import suggest as R

    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a"), ("c", "x"), ("x", "d"), ("y", "a")]
    out = defaultdict(list)
    for s, t in pairs:
        out[s].append(t)
    count = defaultdict(int)

    def walk(path):
        for t in out[path[-1]]:
            if t not in path:
                for e in zip(path, path[1:] + [t], strict=True):
                    count[e] += 1
                walk(path + [t])

    for n in {x for p in pairs for x in p}:
        walk([n])
    cycle = [("c1", i, *p) for i, p in enumerate(pairs[:5])]
    found = R.weakest_cycle_edge(spark.createDataFrame(pairs, "source string, target string"), spark.createDataFrame(cycle, "cycle string, at int, source string, target string")).collect()
    best = min(cycle, key=lambda r: (count[r[2], r[3]], r[1]))
    assert [tuple(r) for r in found] == [("c1", best[2], best[3], count[best[2], best[3]])]


def test_models_are_saved(spark, tmp_path):
    """Models that were written and read again say what they said before; rows of keys without one get null."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "k", rng.normal(size=3).tolist()) for i in range(150)], "i long, key string, features array<double>")
    v = F.col("features")
    sinks.save_model({"forests": T.fit_forests(rows, "key", v), "neighbours": T.fit_neighbours(rows, "key", v, k=4), "directions": T.fit_directions(rows, components=2)}, f"{tmp_path}/m")
    m = sinks.load_model(spark, f"{tmp_path}/m", "forests", "neighbours", "directions")
    both = [
        (T.isolation_forest(rows, "key", v), T.isolation_forest(rows, "key", v, models=m["forests"]), "iso_score"),
        (T.local_outlier_factor(rows, "key", v, k=4), T.local_outlier_factor(rows, "key", v, models=m["neighbours"]), "lof"),
        (T.reconstruction_error(rows, components=2), T.reconstruction_error(rows, model=m["directions"]), "recon_error"),
    ]
    for direct, loaded, column in both:
        assert {r["i"]: r[column] for r in direct.collect()} == {r["i"]: r[column] for r in loaded.collect()}
    other = T.isolation_forest(rows.withColumn("key", F.lit("new")), "key", v, models=m["forests"]).collect()
    assert len(other) == 150 and all(r["iso_score"] is None and r["iso_outlier"] is None for r in other)
    points = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "i long, v double")
    sinks.save_model({"centres": T.fit_centres(points, ["v"])}, f"{tmp_path}/c")
    centres = sinks.load_model(spark, f"{tmp_path}/c", "centres")["centres"]
    assert sorted(map(tuple, T.cluster_outlier_factor(points, ["v"], centres=centres).collect())) == sorted(map(tuple, T.cluster_outlier_factor(points, ["v"]).collect()))
    assert T.reconstruction_error(rows.limit(0)).count() == 0


def test_cells_hold_the_rows_before(spark):
    """Frames over cells equal frames over whole keys, a hot one and a null one among them."""
    rng = np.random.default_rng(9)
    rows = [(i, [None, "hot", "hot", "hot", "b"][int(rng.integers(5))], int(rng.integers(40)), None if i % 11 == 0 else int(rng.integers(9))) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, key string, ts long, v long").repartition(6)
    before = defaultdict(list)
    want = {}
    for seq, key, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        before[key].append(v)
        known = [x for x in before[key][-5:] if x is not None]
        want[seq] = (sum(known) if known else None, sum(x or 0 for x in before[key][:-1]))
    frame = Window.partitionBy("key", "__cell").orderBy("__i").rowsBetween(-4, 0)
    for cell_rows in (3, 50, 1_000):
        last = in_cells(df, ["key"], ["ts", "seq"], 4, cell_rows).withColumn("s", F.sum("v").over(frame)).where("__own")
        assert {r["seq"]: r["s"] for r in last.collect()} == {k: s for k, (s, _) in want.items()}
        total = sum_before(df, ["key"], ["ts", "seq"], F.col("v"), "t", cell_rows).collect()
        assert len(total) == 400 and {r["seq"]: r["t"] for r in total} == {k: t for k, (_, t) in want.items()}
    assert sum_before(df.limit(0), ["key"], ["ts", "seq"], F.col("v"), "t").count() == 0
