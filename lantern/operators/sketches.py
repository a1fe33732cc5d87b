"""Documented analytics beyond the core: rolling scores, grouping in time and space, criticality, baselines by hour, batch Q values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.operators.graph_algo import clustering, degrees, page_rank, reach_counts, sequential_groups, weak_components
from lantern.runtime import cut, in_cells


def _middle(ordered: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """The value at ``share`` of the first ``n`` of each ordered row, between two by their distance; NaN of no values."""
    at = np.maximum(n - 1, 0) * share
    low = np.floor(at).astype(int)
    a, b = (np.take_along_axis(ordered, i[:, None], 1)[:, 0] for i in (low, np.ceil(at).astype(int)))
    return a + (b - a) * (at - low)


def window_statistics(values: np.ndarray, rows: int) -> dict[str, np.ndarray]:
    """``mean, std, q1, q2, q3, mad`` of the last ``rows`` values at each place; NaN is no value.

    Windows are views of the one array, sorted a block at a time, so memory follows neither the number
    of values nor the window. Deviations are from the median, so equal values have none at all.
    """
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(rows - 1, np.nan), values]), rows)
    out = {name: np.empty(len(values)) for name in ("mean", "std", "q1", "q2", "q3", "mad")}
    for s in range(0, len(values), block := max(1, 500_000 // rows)):
        ordered = np.sort(windows[s : s + block], axis=1)
        n = (~np.isnan(ordered)).sum(axis=1)
        q2 = _middle(ordered, n, 0.5)
        off = ordered - q2[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.nansum(off, axis=1) / n
            std = np.where(n > 1, np.sqrt(np.nansum((off - mean[:, None]) ** 2, axis=1) / (n - 1)), np.nan)
        own = {"mean": q2 + mean, "std": std, "q1": _middle(ordered, n, 0.25), "q2": q2, "q3": _middle(ordered, n, 0.75), "mad": _middle(np.sort(np.abs(off), axis=1), n, 0.5)}
        for name, found in own.items():
            out[name][s : s + block] = found
    return out


def rolling_scores(points: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value", rows: int = 100, z: float = 3.0, mad: float = 3.0, iqr: float = 1.5) -> DataFrame:
    """``rolling_z, is_z, is_iqr, is_mad`` over the last ``rows`` values of a key, this one included.

    Keys are cut into cells with the rows before each, and a cell's windows are sorted once for all
    statistics. Nulls and NaN are no values: such a row has a null score and a null ``is_iqr``, and so
    has a score where the window's values are equal or one. A null key is a key; an empty table gives no rows.
    """
    cells = in_cells(points, keys, order, rows - 1)
    columns = points.columns
    added = [T.StructField("rolling_z", T.DoubleType()), *(T.StructField(c, T.BooleanType()) for c in ("is_z", "is_iqr", "is_mad"))]

    def score(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("__i")
        v = cell[value].cast(pa.float64()).to_numpy(zero_copy_only=False)
        s = window_statistics(v, rows)
        gone = np.isnan(v)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(s["std"] > 0, (v - s["mean"]) / s["std"], np.nan)
            spread = iqr * (s["q3"] - s["q1"])
            far = (v < s["q1"] - spread) | (v > s["q3"] + spread)
            from_median = np.where(s["mad"] > 0, np.abs(v - s["q2"]) / s["mad"], 0) > mad
        found = [pa.array(score, mask=np.isnan(score)), pa.array(np.abs(score) > z), pa.array(far, mask=gone), pa.array(from_median & ~gone)]
        out = cell.select(columns)
        for field, column in zip(added, found, strict=True):
            out = out.append_column(field.name, column)
        return out.filter(cell["__own"])

    return cells.groupBy(*keys, "__cell").applyInArrow(score, T.StructType([*points.schema.fields, *added]))


def temporal_groups(events: DataFrame, key: str, ts: str = "ts", gap_seconds: int = 300) -> DataFrame:
    """``group_start`` of each event: a group begins with the first event over ``gap_seconds`` after the last group's begin."""
    return sequential_groups(events, key, ts, gap_seconds)


def spatial_groups(grouped: DataFrame, edges: DataFrame, group: str = "group_start") -> DataFrame:
    """``component`` of each node in its time group: the connected parts among the nodes that the group has."""
    members = grouped.select(F.col(group).alias("g"), "node_id").distinct()
    tag = lambda g, n: F.concat_ws("|", g.cast("string"), n)
    pairs = (
        edges.join(members.select(F.col("node_id").alias("source"), "g"), "source")
        .join(members.select(F.col("node_id").alias("target"), F.col("g").alias("g2")), "target")
        .where("g = g2")
        .select(tag(F.col("g"), F.col("source")).alias("source"), tag(F.col("g"), F.col("target")).alias("target"))
    )
    tagged = members.select("g", F.col("node_id").alias("n"), tag(F.col("g"), F.col("node_id")).alias("node_id"))
    parts = weak_components(tagged, pairs).join(tagged, "node_id")
    return parts.select(F.col("g").alias(group), F.col("n").alias("node_id"), F.substring_index("component", "|", -1).alias("component"))


def criticality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """0.4 in-degree times out-degree, and 0.3 each of the nodes that are reached and that reach."""
    rows = degrees(nodes, edges).join(reach_counts(nodes, edges), "node_id", "left").fillna(0)
    return rows.select("node_id", (0.4 * F.col("in_degree") * F.col("out_degree") + 0.3 * F.col("reached") + 0.3 * F.col("reaching")).alias("criticality"))


def template_frequency(logs: DataFrame, template: str, ts: str = "ts", history: int = 24, least_std: float = 0.1, z: float = 3.0) -> DataFrame:
    """``hour, template, n, z, is_anomaly``: each hour's count of a template against its ``history`` hours before."""
    counts = logs.groupBy(F.date_trunc("hour", ts).alias("hour"), F.col(template).alias("template")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("template").orderBy("hour").rowsBetween(-history, -1)
    score = (F.col("n") - F.avg("n").over(before)) / F.greatest(F.stddev_pop("n").over(before), F.lit(least_std))
    return counts.withColumn("z", score).withColumn("is_anomaly", F.coalesce(F.abs("z") > z, F.lit(False)))


def weighted_ensemble(scored: DataFrame, weights: dict[str, float], share: float = 0.99) -> DataFrame:
    """``ensemble, is_anomaly``: the weighted sum of scores over its maximum, above its ``share`` quantile."""
    total = scored.withColumn("__t", sum((F.coalesce(c, F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0)))
    limits = total.agg(F.max("__t").alias("__max"), F.percentile("__t", F.lit(share)).alias("__cut"))
    rows = total.crossJoin(F.broadcast(limits))  # one row
    return rows.withColumn("ensemble", F.coalesce(F.try_divide("__t", "__max"), F.lit(0.0))).withColumn("is_anomaly", F.col("__t") > F.col("__cut")).drop("__t", "__max", "__cut")


def graph_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, in_degree, out_degree, clustering, rank, density`` of every node."""
    count = nodes.count()
    distinct = edges.where("source <> target").select("source", "target").distinct()
    density = distinct.agg((F.count("*") / F.lit(float(max(1, count * (count - 1))))).alias("density"))
    joined = degrees(nodes, edges).join(clustering(nodes, edges), "node_id").join(page_rank(nodes, edges), "node_id")
    return joined.crossJoin(F.broadcast(density))


def fitted_q(transitions: DataFrame, gamma: float = 0.9, tolerance: float = 1e-4, max_rounds: int = 200) -> DataFrame:
    """``state, action, q`` of transitions ``state, action, reward, next_state``: means of reward plus the discounted best next value, until they settle."""
    grouped = cut(transitions.groupBy("state", "action", "next_state").agg(F.sum("reward").alias("r"), F.count("*").alias("n")))
    q = grouped.groupBy("state", "action").agg(F.lit(0.0).alias("q"))
    for i in range(max_rounds):
        best = q.groupBy(F.col("state").alias("next_state")).agg(F.max("q").alias("best"))
        value = F.sum(F.col("r") + gamma * F.col("n") * F.coalesce("best", F.lit(0.0))) / F.sum("n")
        new = cut(grouped.join(best, "next_state", "left").groupBy("state", "action").agg(value.alias("q")))
        change = new.join(q.withColumnRenamed("q", "old"), ["state", "action"]).agg(F.max(F.abs(F.col("q") - F.col("old")))).first()[0]
        q = new
        if change is None or change < tolerance:
            break
    return q


def calendar_baselines(metrics: DataFrame, keys: Sequence[str] = ("metric_name",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean and sample deviation of each metric per hour of the day and day of the week."""
    return metrics.groupBy(*keys, F.hour(ts).alias("hour"), F.dayofweek(ts).alias("weekday")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))
