"""Rates, ratios and quantiles of samples, step grids and service health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.logs import micros
from lantern.operators.metrics import same_keys

#: Fixed: kinds of nodes that get metrics.
METRIC_KINDS = ("Service", "Deployment", "Pod")
MEGABYTE = 1 << 20


def increases(samples: DataFrame, series: Sequence[str], ts: str = "ts", value: str = "value", tie: Sequence[str] = (), bucket_seconds: int = 3600) -> DataFrame:
    """``increase`` of each sample over the one before in its series; after a reset the value itself; null for the first.

    A series is cut into time buckets, so a long one is many tasks' work; the first sample of a bucket
    follows the last of the bucket before, from a table of one row per bucket. A null label is a label.
    """
    timed = samples.withColumn("__bucket", F.floor(micros(F.col(ts)) / (bucket_seconds * 1_000_000)))
    order = Window.partitionBy(*series, "__bucket").orderBy(ts, *tie)
    names = [f"__k{i}" for i in range(len(series))]
    ends = timed.groupBy(*series, "__bucket").agg(F.max_by(F.struct(value), F.struct(ts, *tie)).alias("__end")).toDF(*names, "__b", "__end")
    carried = ends.withColumn("__carried", F.lag("__end").over(Window.partitionBy(*names).orderBy("__b"))).drop("__end")
    joined = timed.join(carried, same_keys(series) & F.col("__bucket").eqNullSafe(F.col("__b")))
    before = F.coalesce(F.lag(F.struct(value)).over(order), F.col("__carried"))[value]
    grown = joined.withColumn("increase", F.when(before.isNull(), None).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))
    return grown.select(*samples.columns, "increase")


def counter_rate(samples: DataFrame, series: Sequence[str], seconds: int = 300, ts: str = "ts", value: str = "value", tie: Sequence[str] = ()) -> DataFrame:
    """``rate``: increase per second over the trailing ``seconds``, ends included, without extrapolation.

    Each sample is dealt to the bucket of ``seconds`` that it lies in and to the next, where it is only
    counted.
    """
    span = seconds * 1_000_000
    grown = increases(samples, series, ts, value, tie).withColumn("__us", micros(F.col(ts)))
    dealt = grown.withColumn("__home", F.floor(F.col("__us") / span)).withColumn("__bucket", F.explode(F.array("__home", F.col("__home") + 1)))
    trailing = Window.partitionBy(*series, "__bucket").orderBy("__us").rangeBetween(-span, 0)
    rated = dealt.withColumn("rate", F.coalesce(F.sum("increase").over(trailing), F.lit(0.0)) / seconds)
    return rated.where("__bucket = __home").drop("__us", "__home", "__bucket")


def matches(column: Column, regex: str) -> Column:
    """An anchored regular expression, as label matchers are."""
    return column.rlike(f"^({regex})$")


def sum_rate(rates: DataFrame, by: Sequence[str]) -> DataFrame:
    """The latest rate of every series, summed by labels."""
    return rates.groupBy(*by).agg(F.sum("rate").alias("rate"))


def latest(samples: DataFrame, series: Sequence[str], at: Column | None = None, lookback: int = 300, ts: str = "ts", value: str = "value", tie: Sequence[str] = ()) -> DataFrame:
    """The newest value of each series at an instant, of samples not older than ``lookback`` seconds (open at the old end).

    Without an instant the newest sample counts at any age.
    """
    kept = samples if at is None else samples.where((F.col(ts) <= at) & (micros(F.col(ts)) > micros(at) - lookback * 1_000_000))
    return kept.groupBy(*series).agg(F.max_by(value, F.struct(ts, *tie)).alias(value), F.max(ts).alias(ts))


def memory_mb(samples: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Sum of bytes in units of 2**20."""
    return samples.groupBy(*by).agg((F.sum(value) / MEGABYTE).alias("memory_mb"))


def error_ratio(rates: DataFrame, by: Sequence[str], is_error: Column) -> DataFrame:
    """Rate of errors over the rate of all; no row where a side has no series, null for 0 over 0."""
    sums = rates.groupBy(*by).agg(
        F.sum(F.when(is_error, F.col("rate"))).alias("errors"), F.sum("rate").alias("total")
    )
    return sums.where("errors is not null and total is not null").select(*by, F.try_divide("errors", "total").alias("error_ratio"))


def histogram_quantile(buckets: DataFrame, by: Sequence[str], q: float = 0.95, le: str = "le", count: str = "count") -> DataFrame:
    """The ``q`` quantile of cumulative buckets: linear inside the first bucket that reaches it.

    In the unbounded bucket the greatest finite bound is the answer; the first bucket starts at 0
    when its bound is positive. Without the unbounded bucket, or without observations, it is null.
    """
    order = Window.partitionBy(*by).orderBy(le)
    spread = buckets.withColumns({"__low": F.lag(le).over(order), "__before": F.coalesce(F.lag(count).over(order), F.lit(0.0))})
    total = buckets.groupBy(*by).agg(F.max_by(count, le).alias("__total"), F.max(le).alias("__top"), F.max(F.when(F.col(le) < float("inf"), F.col(le))).alias("__finite"))
    joined = spread.join(total, list(by)).withColumn("__rank", q * F.col("__total"))
    reached = joined.where(F.col(count) >= F.col("__rank")).groupBy(*by).agg(
        F.min_by(F.struct(le, count, "__low", "__before", "__rank", "__total", "__top", "__finite"), le).alias("b")
    )
    low = F.coalesce(F.col("b.__low"), F.when(F.col(f"b.{le}") > 0, 0.0).otherwise(F.col(f"b.{le}")))
    inside = low + (F.col(f"b.{le}") - low) * F.try_divide(F.col("b.__rank") - F.col("b.__before"), F.col(f"b.{count}") - F.col("b.__before"))
    answer = F.when((F.col("b.__top") < float("inf")) | (F.col("b.__total") == 0), None).when(F.col(f"b.{le}") == float("inf"), F.col("b.__finite")).otherwise(inside)
    return reached.select(*by, answer.alias("quantile"))


def cumulative_buckets(samples: DataFrame, by: Sequence[str], bounds: Sequence[float], value: str = "value") -> DataFrame:
    """``le, count`` of cumulative buckets with an unbounded last one, in one pass."""
    edges = [*map(float, bounds), float("inf")]
    counts = samples.groupBy(*by).agg(*[F.sum(F.when(F.col(value) <= b, 1.0).otherwise(0.0)).alias(f"__{i}") for i, b in enumerate(edges)])
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"__{i}").alias("count")) for i, b in enumerate(edges)]))
    return counts.select(*by, rows.alias("b")).select(*by, "b.le", "b.count")


def service_metrics(samples: DataFrame, names: Sequence[str], key: str = "service") -> DataFrame:
    """One row per service with the mean of each named metric, null where it has none; one aggregation for all services and metrics."""
    return samples.groupBy(key).agg(*[F.avg(F.when(F.col("metric_name") == n, F.col("value"))).alias(n) for n in names])


def node_metrics(cpu: DataFrame, memory: DataFrame, disk: DataFrame, network: DataFrame) -> DataFrame:
    """Per node: share of busy processor time, used memory in GB, disk use in percent, traffic in MB per second.

    Modes other than ``idle`` are busy; devices other than ``lo`` are summed. A node that one part
    lacks has null there.
    """
    busy = cpu.groupBy("node").agg(F.try_divide(F.sum(F.when(F.col("mode") != "idle", F.col("rate"))), F.sum("rate")).alias("cpu_usage"))
    used = memory.groupBy("node").agg((F.sum(F.col("total") - F.col("available")) / (1 << 30)).alias("memory_gb"))
    full = disk.groupBy("node").agg((100 * F.try_divide(F.sum(F.col("size") - F.col("free")), F.sum("size"))).alias("disk_percent"))
    traffic = network.where("device <> 'lo'").groupBy("node").agg((F.sum("rx") / MEGABYTE).alias("rx_mb"), (F.sum("tx") / MEGABYTE).alias("tx_mb"))
    return busy.join(used, "node", "full").join(full, "node", "full").join(traffic, "node", "full")


def step_grid(samples: DataFrame, series: Sequence[str], start: Column, end: Column, step: int, lookback: int = 300, ts: str = "ts", value: str = "value", tie: Sequence[str] = ()) -> DataFrame:
    """``at, value`` of each series on a grid of instants: the newest sample of the ``lookback`` seconds before each.

    Every sample is dealt to the grid instants that it can answer, ``lookback / step`` of them, so there
    is no range join and no window over the whole series.
    """
    us, first, last = micros(F.col(ts)), micros(start), micros(end)
    width, back = step * 1_000_000, lookback * 1_000_000
    low = F.greatest(F.lit(0), F.ceil((us - first) / width)).cast("long")
    high = F.least(F.floor((last - first) / width), F.ceil((us + back - first) / width) - 1).cast("long")
    dealt = samples.withColumns({"__low": low, "__high": high}).where("__low <= __high").withColumn("__i", F.explode(F.sequence("__low", "__high")))
    newest = dealt.groupBy(*series, "__i").agg(F.max_by(value, F.struct(ts, *tie)).alias("value"))
    return newest.select(*series, F.timestamp_micros(first + F.col("__i") * width).cast("timestamp_ntz").alias("at"), "value")


def attach_metrics(nodes: DataFrame, metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nodes with the metrics of their name; only services, deployments and pods get any, the others keep what they have."""
    plain = nodes.drop(*columns)
    joined = plain.join(metrics.select(F.col("service").alias("__s"), *columns), (F.col("name") == F.col("__s")) & F.col("kind").isin(*METRIC_KINDS), "left")
    return joined.drop("__s")


def health_status(error: Column, latency: Column, cpu: Column, memory: Column) -> Column:
    """The first rung that holds of a ladder, so an earlier warning hides a later critical; healthy with any metric, null with none."""
    some = F.coalesce(error, latency, cpu, memory).isNotNull()
    return (
        F.when(error > 0.1, "critical").when(error > 0.01, "warning")
        .when(latency > 1.0, "critical").when(latency > 0.5, "warning")
        .when(cpu > 0.9, "critical").when(cpu > 0.7, "warning")
        .when(memory > 1024, "warning")
        .when(some, "healthy")
    )
