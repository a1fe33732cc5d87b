"""Scores over the last rows of a key against plain windows."""

from collections import defaultdict

import numpy as np

from lantern.operators import sketches as X


def test_statistics_of_windows():
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=400), 1)
    values[rng.integers(400, size=60)] = np.nan
    values[:3] = np.nan
    for rows in (1, 2, 7, 100, 1000):
        found = X.window_statistics(values, rows)
        for i in range(len(values)):
            own = values[max(0, i + 1 - rows) : i + 1]
            own = own[~np.isnan(own)]
            if not len(own):
                assert all(np.isnan(found[c][i]) for c in found)
                continue
            want = {"mean": own.mean(), "q1": np.quantile(own, 0.25), "q2": np.median(own), "q3": np.quantile(own, 0.75), "mad": np.median(np.abs(own - np.median(own)))}
            assert all(np.isclose(found[c][i], want[c]) for c in want)
            assert np.isnan(found["std"][i]) if len(own) < 2 else np.isclose(found["std"][i], own.std(ddof=1))


def test_equal_values_have_no_spread():
    assert (X.window_statistics(np.full(50, 0.1), 7)["std"][1:] == 0).all()


def test_scores_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [None, "hot", "hot", "b"][int(rng.integers(4))], None if i % 9 == 0 else float(np.round(rng.normal() * (20 if i % 37 == 0 else 1), 2)), "kept") for i in range(500)]
    points = spark.createDataFrame(rows, "seq long, key string, value double, mean string").repartition(6)
    found = {r["seq"]: r for r in X.rolling_scores(points, ["key"], ["seq"], rows=20).collect()}
    assert len(found) == 500 and all(r["mean"] == "kept" for r in found.values())
    before = defaultdict(list)
    for seq, key, v, _ in rows:
        before[key].append(v)
        own = np.array([x for x in before[key][-20:] if x is not None])
        r = found[seq]
        if v is None:
            assert r["rolling_z"] is None and r["is_iqr"] is None and not r["is_z"] and not r["is_mad"]
            continue
        std = own.std(ddof=1) if len(own) > 1 else 0.0
        assert r["rolling_z"] is None if std == 0 else np.isclose(r["rolling_z"], (v - own.mean()) / std)
        assert r["is_z"] == (std > 0 and abs(v - own.mean()) / std > 3)
        q1, q2, q3 = np.quantile(own, [0.25, 0.5, 0.75])
        assert r["is_iqr"] == (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1))
        spread = np.median(np.abs(own - q2))
        assert r["is_mad"] == (spread > 0 and abs(v - q2) / spread > 3)
    assert X.rolling_scores(points.limit(0), ["key"], ["seq"]).count() == 0
