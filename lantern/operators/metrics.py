"""Metric samples against statistical baselines."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.runtime import in_cells

#: Fixed: newest samples of a key that are trained on, and the least numbers for each model.
MAX_POINTS, MIN_POINTS = 10_000, 100
#: Fixed: limits of the simple flags.
LIMITS = {"cpu": 80.0, "memory": 90.0, "latency": 500.0, "error": 0.05, "zscore": 3.0}
#: Fixed: parts of tokens that mark errors and warnings, and terms that are always watched.
ERROR_PARTS = ("error", "fail", "exception", "critical", "crash")
WARNING_PARTS = ("warn", "slow", "timeout", "delay")


def metric_key(name: Column, kind: Column, service: Column, dimensions: Column | None = None) -> Column:
    """name_type, then the service, then each dimension as key_value in the order of keys, where there are any."""
    parts = [name, kind, service]
    if dimensions is not None:
        pairs = F.transform(F.array_sort(F.map_entries(dimensions)), lambda e: F.concat_ws("_", e["key"], e["value"]))
        parts.append(F.when(F.size(dimensions) > 0, F.concat_ws("_", pairs)))
    return F.concat_ws("_", *parts)


def training_window(points: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int = MAX_POINTS, least: int = MIN_POINTS) -> DataFrame:
    """The newest ``most`` rows of each key, of keys with ``least`` rows at least; a null key is a key."""
    newest = points.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= most).drop("__n")
    enough = points.groupBy(*keys).agg(F.count("*").alias("__rows")).where(F.col("__rows") >= least).drop("__rows")
    return newest.join(enough.toDF(*[f"__k{i}" for i in range(len(keys))]), same_keys(keys), "left_semi")


def same_keys(keys: Sequence[str]) -> Column:
    """Whether the columns ``keys`` equal ``__k0`` and so on, nulls among them."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])


def standardise(points: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``standardised``: the value less its key's mean over its population deviation; a deviation of 0 counts as 1, a null key is a key, null values stay null."""
    stats = points.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__std")).toDF(*[f"__k{i}" for i in range(len(keys))], "__mean", "__std")
    scale = F.when(F.col("__std") == 0, 1.0).otherwise(F.col("__std"))
    joined = points.join(stats, same_keys(keys))
    return joined.select(*points.columns, ((F.col(value) - F.col("__mean")) / scale).alias("standardised"))


def expected_value(points: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value", last: int = 10) -> DataFrame:
    """``expected_value``: the mean of the last ten values of the key, this one included."""
    rows = in_cells(points, keys, order, last - 1)
    frame = Window.partitionBy(*keys, "__cell").orderBy("__i").rowsBetween(1 - last, 0)
    return rows.withColumn("expected_value", F.avg(value).over(frame)).where("__own").select(*points.columns, "expected_value")


def best_model(scored: DataFrame, scores: Sequence[str], cut: float = 0.7) -> DataFrame:
    """``score, model_name, is_anomaly`` of the highest score, the first model on ties, flagged above ``cut``."""
    top = F.greatest(*[F.col(s) for s in scores]) if len(scores) > 1 else F.col(scores[0])
    name = F.coalesce(*[F.when(F.col(s) == F.col("score"), F.lit(s)) for s in scores])
    return scored.withColumn("score", top).withColumn("model_name", name).withColumn("is_anomaly", F.coalesce(F.col("score") > cut, F.lit(False)))


def get_metric_anomalies(anomalies: DataFrame, since=None, service: str | None = None, metric_type: str | None = None, min_score: float = 0.7) -> DataFrame:
    """Anomalies not before ``since``, of a service and type, and of that score at least."""
    out = anomalies.where(F.col("score") >= min_score)
    for column, wanted in (("service", service), ("metric_type", metric_type)):
        out = out if wanted is None else out.where(F.col(column) == wanted)
    return out if since is None else out.where(F.col("ts") >= F.lit(since))


def pivot_metrics(metrics: DataFrame, names: Sequence[str], keys: Sequence[str] = ("ts", "service"), name: str = "metric_name", value: str = "value") -> DataFrame:
    """A column for each named metric; several values of a key and metric are averaged. The names are given, so no pass looks for them."""
    return metrics.groupBy(*keys).pivot(name, list(names)).agg(F.avg(value))


def fit_zscore(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``<c>_mean`` and ``<c>_std``, the sample deviation, of every column."""
    return wide.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def detect_zscore(wide: DataFrame, baseline: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """``z_score``, the greatest deviation of any column from its mean in units of its deviation, and ``is_anomaly`` above ``threshold``.

    Null and NaN values are skipped; any other value of a column without deviation is infinitely far.
    """
    inf = F.lit(float("inf"))

    def one(c: str) -> Column:
        away = F.abs(F.col(c) - F.col(f"{c}_mean"))
        z = F.when(F.col(f"{c}_std") == 0, F.when(away > 0, inf)).otherwise(away / F.col(f"{c}_std"))
        return F.when(~F.isnan(z), z)

    zs = [one(c) for c in columns]
    joined = wide.crossJoin(F.broadcast(baseline))  # one row
    scored = joined.withColumn("z_score", F.greatest(*zs) if len(zs) > 1 else zs[0])
    return scored.withColumn("is_anomaly", F.coalesce(F.col("z_score") > threshold, F.lit(False))).select(*wide.columns, "z_score", "is_anomaly")


def metric_profile(metrics: DataFrame, keys: Sequence[str] = ("metric_name",), value: str = "value", exact: bool = True) -> DataFrame:
    """Mean, population deviation and 95th percentile of each metric; by linear interpolation, or approximately for very many rows."""
    p95 = F.percentile(value, F.lit(0.95)) if exact else F.percentile_approx(value, 0.95, 10_000)
    return metrics.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), p95.alias("p95"))


def threshold_flags(rows: DataFrame, limits: Mapping[str, float] = LIMITS) -> DataFrame:
    """``<name>_high`` for every limit whose column the rows have."""
    flags = {f"{c}_high": F.coalesce(F.col(c) > F.lit(limit), F.lit(False)) for c, limit in limits.items() if c in rows.columns}
    return rows.withColumns(flags) if flags else rows


def keyword_profile(logs: DataFrame, message: str = "message") -> DataFrame:
    """``token, n, is_error, is_warning`` of the lower-cased tokens that hold a part which marks errors or warnings."""
    tokens = logs.select(F.explode(F.split(F.lower(F.col(message)), r"\s+")).alias("token")).where("token <> ''")
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    flagged = counts.select("token", "n", F.col("token").rlike("|".join(ERROR_PARTS)).alias("is_error"), F.col("token").rlike("|".join(WARNING_PARTS)).alias("is_warning"))
    return flagged.where("is_error or is_warning")


def run_detectors(detectors: Mapping[str, Callable[[DataFrame], DataFrame]], frames: Mapping[str, DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """Each detector over the frame of its name, united with a ``detector`` column; and the errors of those that failed to plan.

    A detector that fails doesn't keep the others from running.
    """
    out, errors = None, {}
    for name, detector in detectors.items():
        if name not in frames:
            continue
        try:
            one = detector(frames[name]).withColumn("detector", F.lit(name))
        except Exception as error:  # noqa: BLE001
            errors[name] = str(error)
            continue
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out, errors
