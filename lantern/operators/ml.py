"""Outlier models per key, and text features of log lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from io import BytesIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.operators.metrics import same_keys
from lantern.operators.neighbours import Cells, finite, key_text
from lantern.runtime import cut, in_order, small_batches

#: Fixed: rows that a tree is grown on, trees, share of outliers.
TREE_ROWS, TREES, CONTAMINATION = 256, 100, 0.05


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n keys."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_trees(x: np.ndarray, seed: int, trees: int = TREES, rows: int = TREE_ROWS) -> list[dict]:
    """Isolation trees as flat arrays: split column (-1 at leaves), split value, left child, size."""
    rng = np.random.default_rng(seed)
    most = int(np.ceil(np.log2(max(2, min(rows, len(x))))))
    out = []
    for _ in range(trees):
        own = x[rng.choice(len(x), min(rows, len(x)), replace=False)]
        column, value, left, size, depth = [], [], [], [], []
        todo = [own]
        levels = [0]
        while len(column) < len(todo):
            i = len(column)
            part, level = todo[i], levels[i]
            spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(x.shape[1])
            open_columns = np.flatnonzero(spread > 0)
            if level >= most or len(part) <= 1 or not len(open_columns):
                column.append(-1), value.append(0.0), left.append(-1)
            else:
                c = int(rng.choice(open_columns))
                v = float(rng.uniform(part[:, c].min(), part[:, c].max()))
                column.append(c), value.append(v), left.append(len(todo))
                todo += [part[part[:, c] < v], part[part[:, c] >= v]]
                levels += [level + 1, level + 1]
            size.append(len(part)), depth.append(level)
        out.append({"column": np.array(column), "value": np.array(value), "left": np.array(left), "end": np.array(depth) + _average_path(np.array(size)), "rows": len(own)})
    return out


def isolation_scores(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """2 ** -(mean depth / expected depth): near 1 for outliers."""
    total = np.zeros(len(x))
    for t in trees:
        at = np.zeros(len(x), dtype=int)
        while True:
            inner = t["column"][at] >= 0
            if not inner.any():
                break
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = t["left"][node] + (x[rows, t["column"][node]] >= t["value"][node])
        total += t["end"][at]
    return 2.0 ** (-(total / len(trees)) / max(1e-9, float(_average_path(trees[0]["rows"]))))


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    """A model as bytes: named arrays of numbers, nothing that runs when it is read."""
    out = BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(model: bytes) -> dict[str, np.ndarray]:
    with np.load(BytesIO(model), allow_pickle=False) as found:
        return {name: found[name] for name in found.files}


def _forest_arrays(trees: list[dict]) -> dict[str, np.ndarray]:
    """The trees one after another, with where each ends."""
    joined = {c: np.concatenate([t[c] for t in trees]) for c in ("column", "value", "left", "end")}
    return joined | {"ends": np.cumsum([len(t["column"]) for t in trees]), "rows": np.array([t["rows"] for t in trees])}


def _forest_trees(arrays: dict[str, np.ndarray]) -> list[dict]:
    parts = {c: np.split(arrays[c], arrays["ends"][:-1]) for c in ("column", "value", "left", "end")}
    return [{c: parts[c][i] for c in parts} | {"rows": int(n)} for i, n in enumerate(arrays["rows"])]


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=float) for x in rows])


def _once_each(score, rows: pd.Series) -> np.ndarray:
    """``score`` of the vectors in ``rows``, equal ones scored once."""
    vectors = [np.asarray(x, dtype=float) for x in rows]
    place, _ = pd.factorize(np.array([v.tobytes() for v in vectors] + [None], dtype=object)[:-1])
    _, first = np.unique(place, return_index=True)
    return score(np.stack([vectors[i] for i in first]))[place]


def _apply_models(rows: DataFrame, models: DataFrame, key: str, score, column: str, rows_per_task: int = 50_000) -> DataFrame:
    """``rows`` with ``column`` from ``score(model, x)``; ``models`` are ``key, model``, one per key.

    A key's rows are dealt to as many salts as it has ``rows_per_task`` rows; each salt's task gets its
    rows and one copy of the model. A null key is a key; rows of a key without a model get null.
    """
    counts = rows.groupBy(F.col(key).alias("__k")).agg(F.ceil(F.count("*") / rows_per_task).alias("__salts"))
    dealt = rows.join(counts, F.col(key).eqNullSafe(F.col("__k"))).withColumn("__salt", F.pmod(F.xxhash64(*[c for c in rows.columns if not isinstance(rows.schema[c].dataType, T.MapType)]), F.col("__salts"))).drop("__k", "__salts")
    named = models.select(F.col("key").alias("__key"), F.col("model").alias("__model"))
    copies = named.join(counts, F.col("__key").eqNullSafe(F.col("__k"))).select("__key", "__model", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1)).alias("__salt"))
    fields = [f for f in rows.schema.fields if f.name != "__x"]

    def run(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        found = _once_each(lambda x: score(_unpacked(model["__model"].iloc[0]), x), own["__x"]) if len(own) and len(model) else [None] * len(own)
        return own[[f.name for f in fields]].assign(**{column: found})

    schema = T.StructType([*fields, T.StructField(column, T.DoubleType())])
    return dealt.groupBy(key, "__salt").cogroup(copies.withColumnRenamed("__key", key).groupBy(key, "__salt")).applyInPandas(run, schema)


def _model_rows(rows: DataFrame, key: str, most: int, fit, order: Sequence[Column] = ()) -> DataFrame:
    """``key, model`` fitted on at most ``most`` rows of each key, the first by ``order``, or those of the least hash."""
    kind = rows.schema[key].dataType.simpleString()
    sample = rows.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(*order, F.xxhash64("__x")))).where(F.col("__i") <= most).select(key, "__x")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["__x"])
        # In an order of their own, so that draws don't depend on how rows arrive.
        return pd.DataFrame({"key": [pdf[key].iloc[0]], "model": [_packed(fit(x[np.lexsort(x.T)]))]})

    return sample.groupBy(key).applyInPandas(run, f"key {kind}, model binary")


def fit_forests(points: DataFrame, key: str, features: Column, seed: int = 42, train_rows: int = 10_000, order: Sequence[Column] = ()) -> DataFrame:
    """``key, model``: a forest for each key, grown in its own task on at most ``train_rows`` rows, the first by ``order``, or those of the least hash. The table can be saved."""
    return _model_rows(points.withColumn("__x", features), key, train_rows, lambda x: _forest_arrays(grow_trees(x, seed)), order)


def isolation_forest(
    points: DataFrame, key: str, features: Column, contamination: float = CONTAMINATION, seed: int = 42, score_mode: str = "quantile", train_rows: int = 10_000, models: DataFrame | None = None, order: Sequence[Column] = ()
) -> DataFrame:
    """``iso_score, iso_outlier`` of every row, by a forest of its key: that of ``models`` if given, else of ``fit_forests``.

    Outliers are the share ``contamination`` of highest scores per key; ``reference`` mode takes 0.5 plus
    the score above 0.7. Rows with a null key are rows of one key; those of a key that ``models`` lacks
    have nulls.
    """
    rows = points.withColumn("__x", features)
    models = fit_forests(points, key, features, seed, train_rows, order) if models is None else models
    scored = cut(_apply_models(rows, models, key, lambda model, x: isolation_scores(_forest_trees(model), x), "iso_score"))
    if score_mode == "reference":
        return scored.withColumn("iso_outlier", 0.5 + F.col("iso_score") > 0.7)
    cuts = scored.groupBy(F.col(key).alias("__k")).agg(F.percentile_approx("iso_score", 1 - contamination, 10_000).alias("__cut"))
    return scored.join(cuts, F.col(key).eqNullSafe(F.col("__k"))).withColumn("iso_outlier", F.col("iso_score") > F.col("__cut")).drop("__k", "__cut")


def _lof_of_run(v: np.ndarray, k: int) -> np.ndarray:
    """Outlier factors of sorted numbers against each other; right from place 3 * ``k`` on to as far before the end."""
    n, most = len(v), min(k, len(v) - 1)
    if most < 1:
        return np.full(n, np.nan)
    # Of rows as far away the nearer in place come first, so the nearest of equal values lie within k places too.
    place = np.arange(n)[:, None] + (np.arange(1, k + 1)[:, None] * np.array([-1, 1])).reshape(1, -1)
    inside = (place >= 0) & (place < n)
    place = np.clip(place, 0, n - 1)
    away = np.where(inside, np.abs(v[place] - v[:, None]), np.inf)
    order = np.argsort(away, axis=1, kind="stable")[:, :most]
    near, d = np.take_along_axis(place, order, 1), np.take_along_axis(away, order, 1)
    reach = np.maximum(d, d[:, -1][near]).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        density = np.where(reach > 0, most / reach, np.inf)
        return np.where(np.isinf(density), 1.0, (density[near] / density[:, None]).mean(axis=1))


def lof_1d(points: DataFrame, keys: Sequence[str], value: str = "value", tie: Sequence[str] = (), k: int = 20, cell_rows: int = 20_000) -> DataFrame:
    """``lof`` of numbers per key: the mean reach density of the ``k`` nearest over the row's own; near 1 for inliers.

    In order of value, of rows as far away the nearer in place first, the nearest of a row lie within ``k`` places, what their distances need within
    2 ``k``, and their densities within 3 ``k``. So rows are sorted by key and value in ranges, numbered,
    and cut into cells of ``cell_rows`` that hold the 3 ``k`` places before and after too; no task gets
    a key. Where all distances are 0 the factor is 1. A null key is a key, whose only row has a null
    factor; rows with a null or NaN value have a null factor and are no neighbours.
    """
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    numbered = in_order(points.where(known), *keys, value, *tie, name="__i")
    own = [f"__k{i}" for i in range(len(keys))]
    starts = numbered.groupBy(*keys).agg(F.min("__i").alias("__first"), F.count("*").alias("__rows")).toDF(*own, "__first", "__rows")
    placed = numbered.join(starts, same_keys(keys)).withColumn("__i", F.col("__i") - F.col("__first")).drop("__first")
    cell, last = F.floor(F.col("__i") / cell_rows), F.floor((F.col("__rows") - 1) / cell_rows)
    reach = 3 * k
    cells = F.sequence(F.greatest(F.lit(0), F.floor((F.col("__i") - reach) / cell_rows)), F.least(last, F.floor((F.col("__i") + reach) / cell_rows)))
    dealt = placed.withColumn("__home", cell).withColumn("__cell", F.explode(cells)).drop("__rows")
    fields = [*points.schema.fields, T.StructField("lof", T.DoubleType())]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        pdf["lof"] = _lof_of_run(pdf[value].to_numpy(dtype=float), k)
        return pdf[pdf["__home"] == pdf["__cell"]][[f.name for f in fields]]

    found = dealt.groupBy(*own, "__cell").applyInPandas(run, T.StructType(fields))
    return found.unionByName(points.where(~known | F.col(value).isNull()).withColumn("lof", F.lit(None).cast("double")))


def fit_neighbours(points: DataFrame, key: str, features: Column, k: int = 20, most: int = 10_000, order: Sequence[Column] = ()) -> DataFrame:
    """``key, id, x, reach, density, k`` of the training rows: of each key the newest ``most`` by ``order``, or of the least hash without one. The table can be saved.

    ``reach`` is the distance of the ``k``-th nearest other row, ``density`` one over the mean distance of
    reach to the nearest. Rows without a whole vector are left out; the one row of a key has neither.
    """
    newest = Window.partitionBy(key).orderBy(*order, F.xxhash64("__x"))
    rows = points.withColumn("__x", F.transform(features, lambda v: v.cast("double"))).where(finite(F.col("__x"))).select(key, *[c for c in points.columns if c != key], "__x")
    rows = rows.withColumn("__i", F.row_number().over(newest)).where(F.col("__i") <= most)
    rows = cut(rows.select(F.col(key).alias("key"), key_text(key).alias("k"), F.col("__i").cast("long").alias("id"), F.col("__x").alias("x")))
    found = Cells(rows, k + 1, whole=True).nearest_of(rows.select("k", "x").distinct())
    own = rows.join(found, ["k", "x"]).withColumn("near", F.slice(F.filter("near", lambda p: p["id"] != F.col("id")), 1, k))
    own = cut(own.withColumn("reach", F.element_at("near", -1)["d"]).where(F.size("near") > 0))
    steps = own.select("k", "id", F.explode("near").alias("to")).select("k", "id", F.col("to.id").alias("other"), F.col("to.d").alias("d"))
    ends = steps.join(own.select("k", F.col("id").alias("other"), "reach"), ["k", "other"])
    # Sums in one order, so that reruns agree to the last digit.
    reaches = F.sort_array(F.collect_list(F.greatest("d", "reach")))
    mean = F.aggregate("ds", F.lit(0.0), lambda s, d: s + d) / F.size("ds")
    density = ends.groupBy("k", "id").agg(reaches.alias("ds")).select("k", "id", (1 / F.greatest(mean, F.lit(1e-12))).alias("density"))
    known = own.select("k", "id", "reach").join(density, ["k", "id"])
    return rows.join(known, ["k", "id"], "left").select("key", "id", "x", "reach", "density", F.lit(k).alias("k"))


def local_outlier_factor(
    points: DataFrame, key: str, features: Column, k: int = 20, most: int = 10_000, models: DataFrame | None = None, order: Sequence[Column] = ()
) -> DataFrame:
    """``lof`` of every row against the training rows of its key in ``models``, or else in those of ``fit_neighbours``, scored as new rows.

    The nearest are found exactly: training rows lie in cells around pivots, and a row meets only the
    cells that can hold one of its nearest. Equal vectors are scored once; of training rows as far away
    the newer come first. A key whose model has one row gets 1; one without a model, and a row without
    a whole vector, null.
    """
    models = fit_neighbours(points, key, features, k, most, order) if models is None else models
    trained = cut(models.withColumn("t", key_text("key")))
    first = trained.first()
    k = k if first is None else first["k"]
    rows = points.withColumn("__x", F.transform(features, lambda v: v.cast("double"))).withColumn("__k", key_text(key))
    asked = cut(rows.where(finite(F.col("__x"))).select(F.col("__k").alias("k"), F.col("__x").alias("x")).distinct())
    cells = Cells(trained.where("density is not null").select(F.col("t").alias("k"), "id", "x", "reach", "density"), k, ["reach", "density"], whole=True)
    total = lambda of: F.aggregate("near", F.lit(0.0), lambda s, p: s + of(p)) / F.size("near")
    lof = total(lambda p: p["density"]) * F.greatest(total(lambda p: F.greatest(p["d"], p["reach"])), F.lit(1e-12))
    found = cells.nearest_of(asked).select(F.col("k").alias("__fk"), F.col("x").alias("__fx"), lof.alias("__lof"))
    alone = trained.where("density is null").select(F.col("t").alias("__alone")).distinct()
    scored = rows.join(found, (F.col("__k") == F.col("__fk")) & (F.col("__x") == F.col("__fx")), "left").join(alone, F.col("__k") == F.col("__alone"), "left")
    factor = F.coalesce("__lof", F.when(F.col("__alone").isNotNull() & finite(F.col("__x")), 1.0))
    return scored.withColumn("__lof", factor).select(*points.columns, F.col("__lof").alias("lof"))


def dbscan_outliers(points: DataFrame, key: str, features: Column, eps: float = 0.5, least: int = 5) -> DataFrame:
    """``is_noise``: whether no core point of the row's key lies within ``eps``; a core point has ``least`` rows within ``eps``, itself included.

    Rows are folded by equal vectors with their counts, and fall into boxes whose diagonal is ``eps``. All
    rows of a box of ``least`` rows are core points, so a dense place is settled by a count. Only the
    vectors of other boxes look around, in cells around pivots (see ``Cells``): first for their
    counts and for rows of dense boxes, then for core points among themselves. A null key is a key;
    rows whose vector is null or holds null, NaN or infinity are noise.
    """
    rows = points.withColumn("__x", F.transform(features, lambda v: v.cast("double"))).withColumn("__k", key_text(key))
    # A box is a little smaller, so that rounding takes no pair in it beyond eps.
    box = F.transform("x", lambda v: F.floor(v * F.sqrt(F.size("x")) / F.lit(eps * (1 - 1e-9))))
    folded = rows.where(finite(F.col("__x"))).groupBy(F.col("__k").alias("k"), F.col("__x").alias("x")).agg(F.count("*").alias("n"))
    folded = cut(folded.withColumn("box", box).withColumn("id", F.xxhash64("k", "x")))
    dense = cut(folded.groupBy("k", "box").agg(F.sum("n").alias("all")).where(F.col("all") >= least).select("k", "box"))
    marked = folded.join(dense.withColumn("sure", F.lit(True)), ["k", "box"], "left").withColumn("sure", F.col("sure").isNotNull())
    marked = cut(marked.select("k", "x", "id", "n", F.when(F.col("sure"), F.col("n")).otherwise(0).alias("dense"), "sure"))
    open_ = marked.where(~F.col("sure"))
    around = cut(Cells(marked, 1, ["n", "dense"]).sums_within(open_, eps))
    settled = around.where((F.col("n") >= least) | (F.col("dense") > 0)).select("k", "x")
    rest = around.where((F.col("n") < least) & (F.col("dense") == 0)).select("k", "x")
    core = around.where(F.col("n") >= least).select("k", "x", F.xxhash64("k", "x").alias("id"), F.lit(1).cast("long").alias("cores"))
    reached = Cells(core, 1, ["cores"]).sums_within(rest, eps).where("cores > 0").select("k", "x")
    fine = marked.where("sure").select("k", "x").union(settled).union(reached).withColumn("ok", F.lit(True))
    joined = rows.join(fine.toDF("__fk", "__fx", "__ok"), (F.col("__k") == F.col("__fk")) & (F.col("__x") == F.col("__fx")), "left")
    return joined.select(*points.columns, F.col("__ok").isNull().alias("is_noise"))


def fit_centres(points: DataFrame, features: Sequence[str], clusters: int = 3, large: float = 0.1, seed: int = 42) -> DataFrame:
    """``centre`` of each large cluster, one with a tenth of all rows or more, of all clusters if none is; ``clusters`` rows at most, none without whole rows. The table can be saved."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    # Rows with gaps aren't clustered.
    whole = VectorAssembler(inputCols=list(features), outputCol="__v", handleInvalid="skip").transform(points)
    if whole.isEmpty():
        return points.sparkSession.createDataFrame([], "centre array<double>")
    model = KMeans(k=clusters, seed=seed, featuresCol="__v", predictionCol="__c").fit(whole)
    sizes = model.summary.clusterSizes
    total = sum(sizes)
    centres = [c for c, n in zip(model.clusterCenters(), sizes, strict=True) if n >= large * total] or model.clusterCenters()
    return points.sparkSession.createDataFrame([([float(x) for x in c],) for c in centres], "centre array<double>")


def cluster_outlier_factor(points: DataFrame, features: Sequence[str], clusters: int = 3, large: float = 0.1, seed: int = 42, centres: DataFrame | None = None) -> DataFrame:
    """``cblof``: the distance of a row to the nearest of ``centres``, or else of those of ``fit_centres``; null where a feature is null or NaN."""
    found = fit_centres(points, features, clusters, large, seed) if centres is None else centres
    centres = [r["centre"] for r in found.collect()]  # as many as there are clusters
    if not centres:
        return points.withColumn("cblof", F.lit(None).cast("double"))
    away = [F.sqrt(sum(((F.col(f) - float(c[j])) ** 2 for j, f in enumerate(features)), F.lit(0.0))) for c in centres]
    nearest = F.least(*away) if len(away) > 1 else away[0]
    return points.withColumn("cblof", F.when(~F.isnan(nearest), nearest))


def nearest_centres(x: np.ndarray, clusters: int, seed: int, starts: int = 5, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Centres of at most ``clusters`` clusters and the rows of each: the tightest of several runs, whose first centres are drawn far apart."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < clusters:
            away = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
            if away.sum() == 0:
                break
            centres = np.concatenate([centres, x[[rng.choice(len(x), p=away / away.sum())]]])
        for _ in range(rounds):
            own = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            moved = np.stack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
            if np.array_equal(moved, centres):
                break
            centres = moved
        away = ((x[:, None] - centres[None]) ** 2).sum(-1)
        if best is None or away.min(1).sum() < best[0]:
            best = (away.min(1).sum(), centres, np.bincount(away.argmin(1), minlength=len(centres)))
    return best[1], best[2]


def fit_key_centres(points: DataFrame, key: str, features: Column, clusters: int = 3, large: float = 0.1, seed: int = 42, train_rows: int = 10_000, order: Sequence[Column] = ()) -> DataFrame:
    """``key, model``: for each key the centres of its large clusters, those with a tenth of its training rows or more, of all clusters if none is.

    A key's clusters are found in its own task on at most ``train_rows`` whole rows, the first by ``order``.
    Keys without whole rows have no model. The table can be saved.
    """

    def fit(x: np.ndarray) -> dict[str, np.ndarray]:
        centres, sizes = nearest_centres(x, clusters, seed)
        kept = sizes >= large * len(x)
        return {"centres": centres[kept] if kept.any() else centres}

    return _model_rows(points.withColumn("__x", features).where(finite(F.col("__x"))), key, train_rows, fit, order)


def key_cluster_outlier_factor(
    points: DataFrame, key: str, features: Column, clusters: int = 3, large: float = 0.1, seed: int = 42, train_rows: int = 10_000, models: DataFrame | None = None, order: Sequence[Column] = ()
) -> DataFrame:
    """``cblof``: the distance of a row to the nearest of its own key's centres, in ``models`` or else in those of ``fit_key_centres``.

    So keys of unlike scale don't share clusters. A null key is a key; rows with a null or NaN feature,
    and those of a key without a model, have null.
    """
    models = fit_key_centres(points, key, features, clusters, large, seed, train_rows, order) if models is None else models
    found = _apply_models(points.withColumn("__x", features), models, key, lambda model, x: np.sqrt(((x[:, None] - model["centres"][None]) ** 2).sum(-1).min(1)), "cblof")
    return found.withColumn("cblof", F.when(~F.isnan("cblof"), F.col("cblof")))


def _frequent_runs(words: DataFrame, terms: int) -> list[str]:
    """The ``terms`` most frequent runs of one to three ``__w``, of those as frequent shorter ones and then by name first.

    A run is at most as frequent as each of its words. So only words more frequent than the last of the ``terms`` most
    frequent ones, fewer than ``terms``, can be in a longer run that is among them, and no other is counted.
    """
    first = lambda counts: counts.orderBy(F.desc("n"), "size", "term").limit(terms).collect()
    single = first(words.select(F.explode("__w").alias("term")).groupBy("term").agg(F.count("*").alias("n")).withColumn("size", F.lit(1)))
    least = single[-1]["n"] if len(single) == terms else 0
    able = sorted(r["term"] for r in single if r["n"] > least)
    if not able:
        return [r["term"] for r in single]
    base = len(able) + 1

    @F.arrow_udf("array<struct<code:bigint,n:bigint>>")
    def counted(words: pa.Array) -> pa.Array:
        _, codes = _run_codes(words, able)
        code, n = np.unique(codes[codes >= base], return_counts=True)
        # The whole batch's counts are its first row's.
        ends = np.full(len(words) + 1, len(code), dtype=np.int32)
        ends[0] = 0
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["code", "n"]))

    longer = words.select(F.explode(counted("__w")).alias("r")).groupBy(F.col("r.code").alias("code")).agg(F.sum("r.n").alias("n")).where(F.col("n") > least)
    # Codes are in order of size and then of names.
    runs = [(r["code"], r["n"]) for r in longer.orderBy(F.desc("n"), "code").limit(terms).collect()]
    named = [(n, " ".join(able[c - 1] for c in (code // base**2, code // base % base, code % base) if c)) for code, n in runs]
    found = [(r["n"], 1, r["term"]) for r in single] + [(n, run.count(" ") + 1, run) for n, run in named]
    return [run for _, _, run in sorted(found, key=lambda r: (-r[0], r[1], r[2]))[:terms]]


def _run_codes(words: pa.Array, known: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The row and the code of each run of one to three consecutive words that are all ``known``.

    A word's code is its place in ``known`` from 1 on; a run's has the words' codes as digits to the base of one more than ``known`` holds.
    """
    base, flat = len(known) + 1, words.flatten()
    code = pc.fill_null(pc.index_in(flat, value_set=pa.array(known, flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    rows, codes = [row[code > 0]], [code[code > 0]]
    last = np.arange(len(code))[code > 0]
    run = codes[0]
    for _ in range(2):
        # A run goes on by the next word of the row, if that is known.
        on = last + 1 < len(code)
        last, run = last[on] + 1, run[on]
        on = (code[last] > 0) & (row[last] == row[last - 1])
        last, run = last[on], run[on] * base + code[last[on]]
        rows.append(row[last]), codes.append(run)
    return np.concatenate(rows), np.concatenate(codes)


def _run_counts(words: str, vocabulary: Sequence[str]) -> Column:
    """How often each run of ``vocabulary`` is in the array of words."""
    known = sorted({w for run in vocabulary for w in run.split(" ")})
    base = len(known) + 1
    place = {w: i + 1 for i, w in enumerate(known)}
    wanted = np.array([reduce(lambda code, w: code * base + place[w], run.split(" "), 0) for run in vocabulary], dtype=np.int64)
    order = np.argsort(wanted)

    @F.arrow_udf("array<int>")
    def counted(words: pa.Array) -> pa.Array:
        row, codes = _run_codes(words, known)
        at = np.minimum(np.searchsorted(wanted[order], codes), len(wanted) - 1)
        hit = wanted[order][at] == codes
        counts = np.bincount(row[hit] * len(wanted) + order[at[hit]], minlength=len(words) * len(wanted))
        ends = np.arange(len(words) + 1, dtype=np.int32) * len(wanted)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int32()))

    return counted(words)


def _moments(counts: DataFrame, terms: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Of the arrays ``__n`` of ``terms`` counts: how many there are, in how many each term is, and the exact sums of the counts and of the products of any two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = 0, np.zeros((terms + 2, terms))
        for batch in batches:
            n = _whole_numbers(batch.column(0), terms).astype(float)
            rows += len(n)
            sums += np.vstack([(n > 0).sum(axis=0), n.sum(axis=0), n.T @ n])
        values = np.append(sums.ravel(), rows).astype(np.int64)
        place = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(values[place], pa.int64())], ["place", "value"])

    # A task gives a number for each pair of terms, whatever its rows.
    found = counts.select("__n").mapInArrow(run, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect()
    values = np.zeros((terms + 2) * terms + 1, dtype=object)
    for r in found:
        values[r["place"]] = r["value"]
    sums = values[:-1].reshape(terms + 2, terms)
    return values[-1], sums[0], sums[1], sums[2:]


def _whole_numbers(counts: pa.Array, terms: int) -> np.ndarray:
    return counts.flatten().to_numpy(zero_copy_only=False).reshape(len(counts), terms)


def _fit_projection(counts: DataFrame, terms: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """What each term adds to the features for a count of 1, a row a term, and what is taken off."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.linalg import Vectors

    rows, held, sums, products = _moments(counts, terms)
    rarity = np.log((rows + 1) / (held + 1).astype(float)) + 1
    shared = ((rows * products - np.outer(sums, sums)) / max(1, rows * (rows - 1))).astype(float)
    spread = rarity * np.sqrt(np.diag(shared))
    scale = rarity * np.divide(1.0, spread, out=np.zeros(terms), where=spread > 0)
    if terms <= components or rows <= components:
        return np.diag(scale), np.zeros(terms)
    # Rows of the same covariance, up to a factor, as few as there are terms: Spark's directions have one sign for good.
    sizes, own = np.linalg.eigh(shared * np.outer(scale, scale))
    half = own.T * np.sqrt(np.maximum(sizes, 0))[:, None]
    few = counts.sparkSession.createDataFrame([(Vectors.dense(x),) for x in np.vstack([half, -half])], ["x"])
    weights = scale[:, None] * PCA(k=components, inputCol="x", outputCol="p").fit(few).pc.toArray()
    return weights, (sums / rows).astype(float) @ weights


def _projected(counts: str, weights: np.ndarray, offset: np.ndarray) -> Column:
    """The array of counts times ``weights``, less ``offset``."""

    @F.arrow_udf("array<double>")
    def projected(counts: pa.Array) -> pa.Array:
        n = _whole_numbers(counts, len(weights))
        out = np.tile(0.0 - offset, (len(n), 1))
        # Term by term, so that equal rows get equal features to the last digit wherever they lie.
        for term in np.flatnonzero(n.any(axis=0)):
            out += n[:, [term]] * weights[term]
        ends = np.arange(len(n) + 1, dtype=np.int32) * out.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((out + 0.0).ravel(), pa.float64()))

    return projected(counts)


def log_features(logs: DataFrame, message: str = "message", terms: int = 100, components: int = 10, text: bool = True) -> DataFrame:
    """``features``, an array: frequencies of the ``terms`` most frequent runs of one to three words, weighted by rarity, scaled, and projected to ``components``.

    Words have two characters or more; English stop words are left out. Rarity is ln((n + 1) / (df + 1)) + 1.
    The projection is centred; few rows or terms keep the scaled frequencies. Everything is fitted on the
    sums and products of the rows' frequencies, which are cut without the texts and read once for it. Without ``text`` the rows lose their texts, which then are not read again for the features.
    """
    from pyspark.ml.feature import StopWordsRemover

    small_batches(logs.sparkSession, 1_000)
    stop = StopWordsRemover.loadDefaultStopWords("english")
    known = logs.where(F.col(message).isNotNull())
    words = known.withColumn("__w", F.filter(F.regexp_extract_all(F.lower(message), F.lit(r"\b\w\w+\b"), F.lit(0)), lambda x: ~x.isin(stop)))
    if not text:
        known, words = known.drop(message), words.drop(message)
    vocabulary = _frequent_runs(words.select("__w"), terms)
    if not vocabulary:
        return known.withColumn("features", F.array().cast("array<double>"))
    counted = words.withColumn("__n", _run_counts("__w", vocabulary)).drop("__w")
    cut_rows = cut(counted.select("__n") if text else counted)
    weights, offset = _fit_projection(cut_rows, len(vocabulary), components)
    return (counted if text else cut_rows).withColumn("features", _projected("__n", weights, offset)).drop("__n")


def fit_directions(rows: DataFrame, features: str = "features", components: int = 3, contamination: float = CONTAMINATION) -> DataFrame:
    """One row, ``mean, directions, limit``: the mean, the leading directions, and the error that the share ``contamination`` of the rows exceed. The table can be saved."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    schema = "mean array<double>, directions array<array<double>>, limit double"
    vectors = rows.where(F.col(features).isNotNull()).select(F.col(features), array_to_vector(features).alias("__v"))
    first = vectors.first()
    if first is None:
        return rows.sparkSession.createDataFrame([], schema)
    scaler = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(vectors)
    model = PCA(k=min(components, len(first["__v"])), inputCol="__c", outputCol="__p").fit(scaler.transform(vectors))
    known = ([float(x) for x in scaler.mean], [[float(x) for x in d] for d in model.pc.toArray().T])
    limit = vectors.agg(F.percentile_approx(_error_of(features, *known), 1 - contamination, 10_000)).first()[0]
    return rows.sparkSession.createDataFrame([(*known, limit)], schema)


def _error_of(features: str, mean: Sequence[float], directions: Sequence[Sequence[float]]) -> Column:
    """How far a vector is from its projection on the directions through the mean."""
    fixed = lambda v: F.array(*[F.lit(float(x)) for x in v])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    centred = F.zip_with(F.col(features), fixed(mean), lambda x, m: x - m)
    return F.sqrt(F.greatest(F.lit(0.0), dot(centred, centred) - sum((dot(centred, fixed(d)) ** 2 for d in directions), F.lit(0.0))))


def reconstruction_error(rows: DataFrame, features: str = "features", components: int = 3, contamination: float = CONTAMINATION, model: DataFrame | None = None) -> DataFrame:
    """``recon_error, recon_outlier``: how far a row is from its projection on the leading directions, and whether that is above the limit.

    Both are of ``model`` if given, else of ``fit_directions``. Rows without features have nulls.
    """
    found = (fit_directions(rows, features, components, contamination) if model is None else model).first()
    if found is None:
        return rows.withColumn("recon_error", F.lit(None).cast("double")).withColumn("recon_outlier", F.lit(None).cast("boolean"))
    scored = rows.withColumn("recon_error", _error_of(features, found["mean"], found["directions"]))
    return scored.withColumn("recon_outlier", F.col("recon_error") > found["limit"])


def above_quantile(rows: DataFrame, key: str, score: str, name: str, contamination: float = CONTAMINATION) -> DataFrame:
    """``name``: whether ``score`` is above the key's quantile that leaves the share ``contamination``; a null key is a key."""
    cuts = rows.groupBy(F.col(key).alias("__k")).agg(F.percentile_approx(score, 1 - contamination, 10_000).alias("__cut"))
    return rows.join(cuts, F.col(key).eqNullSafe(F.col("__k"))).withColumn(name, F.coalesce(F.col(score) > F.col("__cut"), F.lit(False))).drop("__k", "__cut")


def log_model_scores(rows: DataFrame, key: str, features: str = "features", eps: float = 0.5, least: int = 5, order: Sequence[Column] = ()) -> DataFrame:
    """``iso, lof, dbscan, reconstruction`` of every row: what four models of its key say, from 0 to 1.

    Isolation forest and outlier factor score where they are among the highest of the key: 0.5 plus the
    forest's score, and the logistic of the factor. Noise is 1. The error of reconstruction scores by
    its logistic where it is among the highest of all rows.
    """
    # Each model reads its rows several times.
    found = cut(isolation_forest(cut(rows), key, F.col(features), order=order))
    found = above_quantile(cut(local_outlier_factor(found, key, F.col(features), order=order)), key, "lof", "__lof")
    found = reconstruction_error(cut(dbscan_outliers(cut(found), key, F.col(features), eps, least)), features)
    logistic = lambda x: 1 / (1 + F.exp(-x))
    one = lambda flag, x: F.when(flag, F.least(F.lit(1.0), x)).otherwise(0.0)
    return found.select(
        *rows.columns, one(F.col("iso_outlier"), 0.5 + F.col("iso_score")).alias("iso"), one(F.col("__lof"), logistic(F.col("lof"))).alias("lof"),
        F.col("is_noise").cast("double").alias("dbscan"), one(F.col("recon_outlier"), logistic(F.col("recon_error"))).alias("reconstruction"),
    )


def ml_log_anomalies(scored: DataFrame, scores: Sequence[str], cut: float = 0.7) -> DataFrame:
    """Anomalies ``ml_anomaly`` of lines whose highest score is above ``cut``, in the shape of pattern anomalies."""
    rows = scored.withColumn("score", F.greatest(*[F.col(s) for s in scores]) if len(scores) > 1 else F.col(scores[0])).where(F.col("score") > cut)
    return rows.select(F.lit("ml_anomaly").alias("pattern_name"), "service", "ts", "seq", F.lit(1).cast("long").alias("count"), F.lit(0.1).alias("expected"), "score", F.lit(3).alias("severity"), (F.col("score") > 0.5).alias("is_anomaly"))
