"""Queries over metric samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators import metrics as A
from lantern.plans.base import query, relation

NAMES = ["view", "signup", "error", "click", "purchase"]
WIDE = "hourly as (select date_trunc('hour', ts) as ts, service, " + ", ".join(f"avg(case when metric_name = '{n}' then value end) as {n}" for n in NAMES) + " from {metrics} group by 1, 2)"
ROUNDED = ", ".join(f"round({n}, 6) as {n}" for n in NAMES)
BASE = "base as (select " + ", ".join(f"avg({n}) as {n}_m, stddev_samp({n}) as {n}_s" for n in NAMES) + " from hourly)"
Z = "greatest(" + ", ".join(f"abs({n} - {n}_m) / {n}_s" for n in NAMES) + ")"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = relation(spark, sf_dir, "metrics").withColumn("ts", F.date_trunc("hour", "ts"))
    return A.pivot_metrics(metrics, NAMES)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in NAMES})


@query("a01_metric_key", "select metric_name || '_' || metric_type || '_' || service || '_region_' || region || '_zone_a' as key, count(*) as n from {metrics} group by 1")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = F.create_map(F.lit("zone"), F.lit("a"), F.lit("region"), F.col("region"))
    keyed = relation(spark, sf_dir, "metrics").select(A.metric_key(F.col("metric_name"), F.col("metric_type"), F.col("service"), dims).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"))


@query(
    "a02_training_window",
    """select metric_name, service, seq from (select *, row_number() over (partition by metric_name, service order by ts desc, seq desc) as i,
       count(*) over (partition by metric_name, service) as n from {metrics}) w where i <= 10000 and n >= 100""",
)
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.training_window(relation(spark, sf_dir, "metrics"), ["metric_name", "service"], [F.desc("ts"), F.desc("seq")])
    return rows.select("metric_name", "service", "seq")


@query(
    "a03_standardise",
    "select seq, round((value - avg(value) over w) / stddev_pop(value) over w, 6) as standardised from {metrics} window w as (partition by metric_name, service)",
)
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.standardise(relation(spark, sf_dir, "metrics"), ["metric_name", "service"]).select("seq", F.round("standardised", 6).alias("standardised"))


@query(
    "a07_expected_value",
    "select seq, round(avg(value) over (partition by metric_name, service order by ts, seq rows between 9 preceding and current row), 6) as expected_value from {metrics}",
)
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.expected_value(relation(spark, sf_dir, "metrics"), ["metric_name", "service"], ["ts", "seq"])
    return out.select("seq", F.round("expected_value", 6).alias("expected_value"))


@query(
    "a08_get_metric_anomalies",
    "select seq, service, metric_type, round(least(1.0, value / 200), 6) as score from {metrics} where least(1.0, value / 200) >= 0.7 and metric_type = 'gauge' and service = 'svc-4' and ts >= timestamp '2024-01-05 00:00:00'",
)
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    scored = relation(spark, sf_dir, "metrics").withColumn("score", F.least(F.lit(1.0), F.col("value") / 200))
    out = A.get_metric_anomalies(scored, since=datetime.datetime(2024, 1, 5), service="svc-4", metric_type="gauge")
    return out.select("seq", "service", "metric_type", F.round("score", 6).alias("score"))


@query("a09_fit_zscore", f"with {WIDE}, {BASE} select " + ", ".join(f"round({n}_m, 6) as {n}_mean, round({n}_s, 6) as {n}_std" for n in NAMES) + " from base")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = A.fit_zscore(hourly(spark, sf_dir), NAMES)
    return fit.select(*[F.round(c, 6).alias(c) for c in fit.columns])


@query("a10_detect_zscore", f"with {WIDE}, {BASE} select ts, service, round({Z}, 6) as z_score, coalesce({Z} > 3, false) as is_anomaly from hourly, base")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = hourly(spark, sf_dir)
    out = A.detect_zscore(wide, A.fit_zscore(wide, NAMES), NAMES)
    return out.select("ts", "service", F.round("z_score", 6).alias("z_score"), "is_anomaly")


@query(
    "a11_metric_profile",
    "select metric_name, service, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(quantile_cont(value, 0.95), 6) as p95 from {metrics} group by 1, 2",
)
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.metric_profile(relation(spark, sf_dir, "metrics"), ["metric_name", "service"])
    return out.select("metric_name", "service", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p95")])


@query(
    "a12_threshold_flags",
    "select seq, value * 2 > 80 as cpu_high, value * 3 > 90 as memory_high, value * 10 > 500 as latency_high, value / 100 > 0.05 as error_high from {metrics}",
)
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = relation(spark, sf_dir, "metrics").select("seq", (v * 2).alias("cpu"), (v * 3).alias("memory"), (v * 10).alias("latency"), (v / 100).alias("error"))
    return A.threshold_flags(rows).drop("cpu", "memory", "latency", "error")


@query(
    "a13_keyword_profile",
    """select token, count(*) as n, regexp_matches(token, 'error|fail|exception|critical|crash') as is_error, regexp_matches(token, 'warn|slow|timeout|delay') as is_warning
       from (select unnest(regexp_split_to_array(lower(message), '\\s+')) as token from {logs}) t where token <> '' and regexp_matches(token, 'error|fail|exception|critical|crash|warn|slow|timeout|delay') group by token""",
)
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.keyword_profile(relation(spark, sf_dir, "logs"))


@query(
    "a14_run_detectors",
    f"""with {WIDE}, {BASE} select 'zscore' as detector, service, count(*) as n from hourly, base where {Z} > 3 group by service
        union all select 'flags', service, count(*) from {{metrics}} where value > 80 group by service""",
)
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = hourly(spark, sf_dir)
    detectors = {
        "zscore": lambda df: A.detect_zscore(df, A.fit_zscore(df, NAMES), NAMES).where("is_anomaly").groupBy("service").agg(F.count("*").alias("n")),
        "flags": lambda df: A.threshold_flags(df.withColumnRenamed("value", "cpu")).where("cpu_high").groupBy("service").agg(F.count("*").alias("n")),
        "broken": lambda df: df.select("no_such_column"),
    }
    metrics = relation(spark, sf_dir, "metrics")
    out, _ = A.run_detectors(detectors, {"zscore": wide, "flags": metrics, "broken": metrics})
    return out


@query("a15_pivot_metrics", f"with {WIDE} select ts, service, {ROUNDED} from hourly")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hourly(spark, sf_dir))
