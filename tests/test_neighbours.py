"""Nearest neighbours, outlier factors and noise of vectors against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.operators import ml as T
from lantern.operators import neighbours as N


def clustered(rng, n, dim):
    """Clusters of unlike density, a line of rows with one value twice, and rows on their own."""
    parts = [rng.normal(size=(n // 2, dim)) * 0.1, rng.normal(size=(n // 4, dim)) * 0.5 + 4, rng.normal(size=(n // 8, dim)) * 5]
    left = n - sum(map(len, parts))
    return np.round(np.concatenate([*parts, np.repeat(rng.normal(size=(-(-left // 2), dim)), 2, axis=0)[:left]]), 3)


def frame(spark, x, keys):
    return spark.createDataFrame([(i, k, v.tolist()) for i, (k, v) in enumerate(zip(keys, x, strict=True))], "i long, key string, v array<double>").repartition(5)


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 40)
    monkeypatch.setattr(N, "CHUNK_ROWS", 60)
    monkeypatch.setattr(N, "TASK_ROWS", 300)


def distances(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


@pytest.mark.parametrize("dim", [1, 3, 10])
def test_nearest_are_the_plain_ones(spark, small_cells, dim):
    rng = np.random.default_rng(dim)
    x = clustered(rng, 700, dim)
    rows = frame(spark, x, ["a"] * 600 + ["b"] * 97 + ["few"] * 3).select("i", F.col("key").alias("k"), "v")
    cells = N.Cells(rows.select("k", F.col("i").alias("id"), F.col("v").alias("x")), 7)
    assert max(len(r["held"]) for r in cells.chunks.collect()) <= 120
    found = {(r["k"], tuple(r["x"])): r["near"] for r in cells.nearest_of(rows.select("k", F.col("v").alias("x")).distinct()).collect()}
    for k, part in (("a", range(600)), ("b", range(600, 697)), ("few", range(697, 700))):
        own = x[part.start : part.stop]
        d = distances(own, own)
        for i in range(len(own)):
            order = np.argsort(d[i], kind="stable")[:7]
            near = found[k, tuple(own[i].tolist())]
            assert [p["id"] for p in near] == [part.start + int(j) for j in order]
            assert np.allclose([p["d"] for p in near], d[i][order])


def test_factor_of_many_rows(spark):
    """The factor of 5,000 rows against their newest 4,000, with the planned cells."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5_000, 4)) * rng.choice([0.2, 1.0, 4.0], size=(5_000, 1))
    found = {r["i"]: r["lof"] for r in T.local_outlier_factor(frame(spark, x, [None] * 5_000), "key", F.col("v"), k=20, most=4_000, order=[F.desc("i")]).collect()}
    own = x[1_000:]
    d = distances(own, own)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :20]
    kd = np.take_along_axis(d, near, 1)
    density = 1 / np.maximum(kd, kd[:, -1][near]).mean(1)
    to = distances(x, own)
    i = np.argsort(to, axis=1)[:, :20]
    want = density[i].mean(1) * np.maximum(np.take_along_axis(to, i, 1), kd[:, -1][i]).mean(1)
    assert np.allclose([found[j] for j in range(5_000)], want)


def test_factor_of_odd_rows(spark):
    rows = [(0, "one", [1.0, 2.0]), (1, "one", None), (2, "k", [0.0, 0.0]), (3, "k", [0.0, 0.0]), (4, "k", [1.0, None]), (5, "k", [float("nan"), 0.0]), (6, "k", [9.0, 9.0])]
    points = spark.createDataFrame(rows, "i long, key string, v array<double>").withColumns({c: F.lit(c) for c in ("k", "x", "id", "t", "n", "near")})
    found = {r["i"]: r["lof"] for r in T.local_outlier_factor(points, "key", F.col("v"), k=2).collect()}
    assert found[0] == 1.0 and found[1] is None and found[4] is None and found[5] is None and found[2] == found[3] is not None and found[6] is not None
    assert T.local_outlier_factor(points.limit(0), "key", F.col("v")).count() == 0


def plain_noise(x, eps, least):
    close = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = close.sum(1) >= least
    return ~(close & core).any(1)


@pytest.mark.parametrize(("dim", "eps"), [(1, 0.05), (2, 0.4), (10, 1.2)])
def test_noise_is_the_plain_one(spark, small_cells, dim, eps):
    rng = np.random.default_rng(dim)
    x = clustered(rng, 800, dim)
    keys = ["a"] * 500 + [None] * 300
    found = {r["i"]: r["is_noise"] for r in T.dbscan_outliers(frame(spark, x, keys), "key", F.col("v"), eps=eps, least=5).collect()}
    want = np.concatenate([plain_noise(x[:500], eps, 5), plain_noise(x[500:], eps, 5)])
    assert [found[i] for i in range(800)] == want.tolist() and 0 < want.sum() < 800


def test_noise_of_odd_rows(spark):
    rows = [(i, "k", [0.0]) for i in range(5)] + [(5, "k", None), (6, "k", [None]), (7, "k", [float("inf")]), (8, "k", [0.4]), (9, "other", [0.0]), (9, "other", [0.0])]
    points = spark.createDataFrame(rows, "n long, k string, x array<double>")
    found = Counter((r["n"], r["is_noise"]) for r in T.dbscan_outliers(points, "k", F.col("x"), eps=0.5, least=5).collect())
    assert found == Counter([(i, False) for i in range(5)] + [(5, True), (6, True), (7, True), (8, False), (9, True), (9, True)])
    assert T.dbscan_outliers(points.limit(0), "k", F.col("x")).count() == 0


def test_factor_by_centres_of_each_key(spark):
    """Keys of unlike scale have centres of their own: what is far in the small one isn't hidden by the large one."""
    rng = np.random.default_rng(6)
    small, large = np.concatenate([rng.normal(size=200) * 0.01, 1 + rng.normal(size=200) * 0.01, [3.0]]), np.concatenate([rng.normal(size=300) * 1000, 1e6 + rng.normal(size=300) * 1000])
    rows = [(i, None, float(v)) for i, v in enumerate(small)] + [(1_000 + i, "large", float(v)) for i, v in enumerate(large)] + [(5_000, "large", None), (5_001, None, float("nan")), (5_002, "gaps", None)]
    points = spark.createDataFrame(rows, "i long, key string, v double").repartition(4)
    found = {r["i"]: r["cblof"] for r in T.key_cluster_outlier_factor(points, "key", F.array("v")).collect()}
    assert max(found, key=lambda i: found[i] or 0 if i < 1_000 else 0) == 400 and found[400] > 1.9
    assert max(found[i] for i in range(400)) < 0.1 and max(found[1_000 + i] for i in range(600)) < 1e4
    assert found[5_000] is None and found[5_001] is None and found[5_002] is None
    assert T.key_cluster_outlier_factor(points.limit(0), "key", F.array("v")).count() == 0


def test_centres():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(50, 2)) + c for c in ((0, 0), (40, 0), (0, 40))])
    centres, sizes = T.nearest_centres(x, 3, 1)
    assert sorted(sizes.tolist()) == [50, 50, 50] and np.allclose(sorted(map(tuple, centres)), sorted(tuple(x[i : i + 50].mean(0)) for i in (0, 50, 100)))
    assert len(T.nearest_centres(np.ones((5, 2)), 3, 1)[0]) == 1


def test_whole_keys_give_a_query_one_way(spark):
    """In many dimensions each query had a row for nearly every cell; the nearest are the same."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1_500, 10))
    rows = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "k string, id long, x array<double>")
    queries = rows.where("id % 50 = 0").select("k", "x")
    whole, cut_up = N.Cells(rows, 3, whole=True), N.Cells(rows, 3)
    ids = lambda cells: {tuple(r["x"]): [p["id"] for p in r["near"]] for r in cells.nearest_of(queries).collect()}
    assert ids(whole) == ids(cut_up) and whole.ways(queries).count() == 30
