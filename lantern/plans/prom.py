"""Queries over counter samples, grids and health."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators import prom as P
from lantern.plans.base import query, relation

SERIES = ["service", "name", "namespace"]
GROWN = """g as (select *, case when before is null then null when value < before then value else value - before end as increase from
    (select *, lag(value) over (partition by service, name, namespace order by ts, seq) as before from {counters}) x),
    r as (select *, coalesce(sum(increase) over (partition by service, name, namespace order by ts range between interval 300 second preceding and current row), 0) / 300 as rate from g)"""
LAST = GROWN + ", z as (select service, name, namespace, arg_max(rate, (ts, seq)) as rate from r group by 1, 2, 3)"


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.counter_rate(relation(spark, sf_dir, "counters"), SERIES, tie=["seq"])


def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest(_rates(spark, sf_dir), SERIES, value="rate", tie=["seq"])


@query("p01_counter_rate", f"with {GROWN} select seq, round(rate, 6) as rate from r")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir).select("seq", F.round("rate", 6).alias("rate"))


@query("p02_cpu_by_pod", f"with {LAST} select namespace, round(sum(rate), 6) as rate from z where regexp_matches(service, '^(svc-1.*)$') group by namespace")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.sum_rate(_last(spark, sf_dir).where(P.matches(F.col("service"), "svc-1.*")), ["namespace"])
    return out.select("namespace", F.round("rate", 6).alias("rate"))


@query("p03_memory_mb", "select service, round(sum(value * 1000000) / 1048576, 6) as memory_mb from {metrics} where metric_name = 'view' group by service")
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "metrics").where("metric_name = 'view'").withColumn("value", F.col("value") * 1000000)
    return P.memory_mb(rows, ["service"]).select("service", F.round("memory_mb", 6).alias("memory_mb"))


@query("p04_request_rate", f"with {LAST} select service, round(sum(rate), 6) as rate from z group by service")
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sum_rate(_last(spark, sf_dir), ["service"]).select("service", F.round("rate", 6).alias("rate"))


@query("p05_error_ratio", f"with {GROWN} select service, round(sum(case when name = 'error' then rate end) / nullif(sum(rate), 0), 6) as error_ratio from r group by service having sum(case when name = 'error' then rate end) is not null")
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.error_ratio(_rates(spark, sf_dir), ["service"], F.col("name") == "error")
    return out.select("service", F.round("error_ratio", 6).alias("error_ratio"))


@query(
    "p06_histogram_quantile",
    """with b as (select service, le, sum(case when value <= le then 1.0 else 0.0 end) as n from {metrics}, (values (10.0), (25.0), (50.0), (100.0), (250.0), (1e308)) x(le) group by service, le),
       w as (select *, coalesce(lag(le) over o, 0.0) as low, coalesce(lag(n) over o, 0.0) as before, 0.95 * max(n) over (partition by service) as want from b window o as (partition by service order by le)),
       f as (select *, row_number() over (partition by service order by le) as i from w where n >= want)
       select service, round(case when le > 1e300 then 250.0 else low + (le - low) * (want - before) / nullif(n - before, 0) end, 6) as quantile from f where i = 1""",
)
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = P.cumulative_buckets(relation(spark, sf_dir, "metrics"), ["service"], [10, 25, 50, 100, 250])
    return P.histogram_quantile(buckets, ["service"]).select("service", F.round("quantile", 6).alias("quantile"))


NAMES = ["view", "signup", "error", "click", "purchase"]
MEANS = ", ".join(f"round(avg(case when metric_name = '{n}' then value end), 6) as {n}" for n in NAMES)


@query("p07_service_metrics", f"select service, {MEANS} from {{metrics}} group by service")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.service_metrics(relation(spark, sf_dir, "metrics"), NAMES).select("service", *[F.round(n, 6).alias(n) for n in NAMES])


@query(
    "p08_node_metrics",
    """select region as node, round(sum(case when metric_name <> 'view' then value end) / sum(value), 6) as cpu_usage, round(sum(value * 3 - value) * 1000000 / 1073741824, 6) as memory_gb,
       round(100 * sum(value * 2 - value * 0.5) / sum(value * 2), 6) as disk_percent,
       round(sum(case when metric_name <> 'error' then value * 1000 end) / 1048576, 6) as rx_mb, round(sum(case when metric_name <> 'error' then value * 10 end) / 1048576, 6) as tx_mb
       from {metrics} group by region""",
)
def p08(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, v = relation(spark, sf_dir, "metrics").withColumnRenamed("region", "node"), F.col("value")
    out = P.node_metrics(
        m.select("node", F.when(F.col("metric_name") == "view", "idle").otherwise("user").alias("mode"), v.alias("rate")),
        m.select("node", (v * 3 * 1000000).alias("total"), (v * 1000000).alias("available")),
        m.select("node", (v * 2).alias("size"), (v * 0.5).alias("free")),
        m.select("node", F.when(F.col("metric_name") == "error", "lo").otherwise("eth0").alias("device"), (v * 1000).alias("rx"), (v * 10).alias("tx")),
    )
    return out.select("node", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(
    "p09_step_grid",
    """with g as (select unnest(generate_series(timestamp '2024-01-03 00:00:00', timestamp '2024-01-04 00:00:00', interval 600 second)) as at)
       select m.service, m.metric_name, g.at, arg_max(m.value, (m.ts, m.seq)) as value from g join {metrics} m on m.ts <= g.at and m.ts > g.at - interval 900 second group by 1, 2, 3""",
)
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda d: F.lit(datetime.datetime(2024, 1, d)).cast("timestamp_ntz")
    return P.step_grid(relation(spark, sf_dir, "metrics"), ["service", "metric_name"], at(3), at(4), 600, lookback=900, tie=["seq"])


@query(
    "p10_latest_value",
    "select service, metric_name, arg_max(value, (ts, seq)) as value, max(ts) as ts from {metrics} where ts <= timestamp '2024-01-15 12:00:00' and ts > timestamp '2024-01-15 12:00:00' - interval 86400 second group by 1, 2",
)
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit(datetime.datetime(2024, 1, 15, 12)).cast("timestamp_ntz")
    return P.latest(relation(spark, sf_dir, "metrics"), ["service", "metric_name"], at=at, lookback=86400, tie=["seq"])


PROFILE = "select 'supplier-' || s_suppkey as service, s_acctbal / 100000 as error_rate, s_acctbal / 10000 as latency_p95 from {supplier} where s_suppkey % 3 <> 1"


@query("p11_attach_metrics", f"select n.node_id, n.kind, round(m.error_rate, 6) as error_rate, round(m.latency_p95, 6) as latency_p95 from {{geo_nodes}} n left join ({PROFILE}) m on n.name = m.service and n.kind in ('Service', 'Deployment', 'Pod')")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = spark.sql(PROFILE, supplier=relation(spark, sf_dir, "supplier"))
    out = P.attach_metrics(relation(spark, sf_dir, "geo_nodes"), metrics, ["error_rate", "latency_p95"])
    return out.select("node_id", "kind", F.round("error_rate", 6).alias("error_rate"), F.round("latency_p95", 6).alias("latency_p95"))


HEALTH = """case when e > 0.1 then 'critical' when e > 0.01 then 'warning' when l > 1.0 then 'critical' when l > 0.5 then 'warning'
    when c > 0.9 then 'critical' when c > 0.7 then 'warning' when m > 1024 then 'warning' when coalesce(e, l, c, m) is not null then 'healthy' end"""
MEASURES = """select seq, case when seq % 5 < 3 then value / 1000 end as e, case when seq % 7 < 5 then value / 60 end as l, case when seq % 3 = 0 then value / 50 end as c,
    case when seq % 11 < 4 then value * 20 end as m from {metrics}"""


@query("p12_health_status", f"select seq, {HEALTH} as status from ({MEASURES}) x")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(MEASURES, metrics=relation(spark, sf_dir, "metrics"))
    return rows.select("seq", P.health_status(F.col("e"), F.col("l"), F.col("c"), F.col("m")).alias("status"))
