"""Queries of streams, outlier models, serving and documented sketches."""

from __future__ import annotations

import datetime
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators import logs as L
from lantern.operators import metrics as A
from lantern.operators import ml as T
from lantern.operators import remediation as E
from lantern.operators import serving as V
from lantern.operators import sketches as X
from lantern.plans.actions import CONF
from lantern.plans.base import query, relation, with_attrs
from lantern.plans.files import staged
from lantern.plans.graphs import geo
from lantern.plans.logs import MATCHES, SCORED
from lantern.plans.metrics import BASE, NAMES, WIDE, Z, hourly
from lantern.runtime import cut
from lantern.sources import readers as S
from lantern.streaming import streams as W


def _in_order(spark: SparkSession, rows: DataFrame, parts: list[str]) -> str:
    """Rows written in several files one after the other, by conditions."""
    path = staged(spark)
    for condition in parts:
        rows.where(condition).coalesce(1).write.mode("append").parquet(path)
    return path


def _stream(spark: SparkSession, path: str, rows: DataFrame, files: int = 1) -> DataFrame:
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _collect(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its result as a table."""
    spark = df.sparkSession
    path = staged(spark)
    if mode == "append":
        df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{path}/out")
    name = f"w{uuid4().hex}"
    df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


DAYS = ["ts < timestamp'2024-01-10'", "ts >= timestamp'2024-01-10' and ts < timestamp'2024-01-20'", "ts >= timestamp'2024-01-20'"]


@query("w01_stream_pattern_anomalies", f"with {SCORED} select pattern_name, service, seq, n as count, round(score, 6) as score, severity from s where score > 0")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "logs")
    out = _collect(W.stream_pattern_anomalies(_stream(spark, _in_order(spark, rows, DAYS), rows)))
    return out.select("pattern_name", "service", "seq", "count", F.round("score", 6).alias("score"), "severity")


@query(
    "w02_stream_pattern_counts",
    f"with {MATCHES} select cast(floor(epoch(ts) / 30) * 30 - k * 30 as bigint) as start, pattern_name, count(*) as n, round(case when count(*) / max(threshold) <= 1 then 0 else least(1.0, (count(*) / max(threshold) - 1) / 9) end, 6) as score from m, (select unnest(generate_series(0, 9)) as k) z group by 1, 2",
)
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "logs")
    out = _collect(W.stream_pattern_counts(_stream(spark, _in_order(spark, rows, DAYS), rows)), "complete")
    return out.select(F.unix_timestamp("start").alias("start"), "pattern_name", "n", F.round("score", 6).alias("score"))


@query("w03_stream_zscore", f"with {WIDE}, {BASE} select ts, service, round({Z}, 6) as z_score, coalesce({Z} > 3, false) as is_anomaly from hourly, base")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = hourly(spark, sf_dir)
    path = staged(spark)
    A.fit_zscore(wide, NAMES).write.parquet(f"{path}/baseline")
    wide.write.parquet(f"{path}/rows")
    stream = spark.readStream.schema(wide.schema).parquet(f"{path}/rows")
    out = _collect(W.stream_zscore(stream, spark.read.parquet(f"{path}/baseline"), NAMES))
    return out.select("ts", "service", F.round("z_score", 6).alias("z_score"), "is_anomaly")


HEALTH = {"error_rate": "error", "latency_p95": "view", "cpu_usage": "click", "memory_usage": "signup"}


@query(
    "w04_stream_health",
    """with l as (select service, metric_name, arg_max(value, (ts, seq)) / 100 as v from {metrics} group by 1, 2), w as (select service, max(v) filter (where metric_name = 'error') as e, max(v) filter (where metric_name = 'view') as l, max(v) filter (where metric_name = 'click') as c, max(v) filter (where metric_name = 'signup') as m from l group by 1)
       select service, case when e > 0.1 then 'critical' when e > 0.01 then 'warning' when l > 1.0 then 'critical' when l > 0.5 then 'warning' when c > 0.9 then 'critical' when c > 0.7 then 'warning' when m > 1024 then 'warning' else 'healthy' end as health_status from w""",
)
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "metrics").withColumn("value", F.col("value") / 100)
    path = staged(spark)
    rows.write.parquet(f"{path}/in")
    W.stream_health(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), HEALTH, f"{path}/out", f"{path}/state", {"availableNow": True}).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("service", "health_status")


@query(
    "w05_stream_incidents",
    f"""with {CONF}, pk as (select a.*, cf.confidence as c from {{actions}} a left join cf on cf.action_id = a.action_id and cf.issue_type = '1-URGENT' where a.target_type = 'service'),
        best as (select coalesce(arg_max(action_id, (c, -lib_seq)) filter (where c >= 0.7), arg_min(action_id, (risk_level, lib_seq))) as action_id from pk)
        select seq, 'metric_anomaly' as type, cast(least(5, floor(2 * value / 60)) as integer) as severity, action_id, 'mitigating' as status from {{metrics}}, best where value > 150""",
)
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = relation(spark, sf_dir, "metrics").selectExpr("seq", "service", "value / 60 as z_score", "value > 150 as is_anomaly", "'metric' as detector", "'1-URGENT' as issue_type")
    path = staged(spark)
    flagged.write.parquet(f"{path}/in")
    confidence = E.rule_confidence(relation(spark, sf_dir, "experiences"))
    W.stream_incidents(spark.readStream.schema(flagged.schema).parquet(f"{path}/in"), relation(spark, sf_dir, "actions"), confidence, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("seq", "type", "severity", "action_id", "status")


@query("w06_late_rows", "select count(*) as n, count(*) filter (where ts < timestamp '2024-01-10') as n_late from {metrics}")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "metrics").withColumn("ts", F.col("ts").cast("timestamp"))
    source, out = _in_order(spark, rows, [*DAYS[1:], DAYS[0]]), staged(spark)
    W.count_late(_stream(spark, source, rows), "1 days", f"{out}/out", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/out").agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late"))


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log lines with their text features, which models read several times."""
    docs = relation(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("service"), F.col("text").alias("message"))
    return cut(T.log_features(docs, text=False).select("seq", "service", F.expr("timestamp'2024-01-01'").alias("ts"), "features"))


def newest() -> list[Column]:
    """The order of training rows of log lines."""
    return [F.desc("ts"), F.desc("seq")]


@query("t01_log_features")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).select("seq", "service", F.posexplode("features").alias("i", "value"))


@query("t02_training_set", "select service, seq from (select *, row_number() over (partition by service order by ts desc, seq desc) as i, count(*) over (partition by service) as n from {logs}) x where i <= 10000 and n >= 100")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.training_window(relation(spark, sf_dir, "logs"), ["service"], newest()).select("service", "seq")


@query("t03_isolation_forest")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.isolation_forest(featured(spark, sf_dir), "service", F.col("features"), order=newest()).select("seq", "service", "iso_score", "iso_outlier")


@query("t04_local_outlier_factor")
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.local_outlier_factor(featured(spark, sf_dir), "service", F.col("features"), order=newest()).select("seq", "service", "lof")


POINTS = "select seq, service, region, round(value / 20, 1) as x, cast(seq % 3 as double) / 10 as y from {metrics}"


@query(
    "t05_dbscan_outliers",
    f"""with p as ({POINTS}), f as (select service, x, y, count(*) as n from p group by 1, 2, 3), c as (select a.service, a.x, a.y from f a join f b on a.service = b.service and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25 group by 1, 2, 3 having sum(b.n) >= 5)
        select p.seq, not exists (select 1 from c where c.service = p.service and (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) <= 0.25) as is_noise from p""",
)
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.sql(POINTS, metrics=relation(spark, sf_dir, "metrics"))
    return T.dbscan_outliers(points, "service", F.array("x", "y")).select("seq", "is_noise")


@query("t06_reconstruction_error")
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.reconstruction_error(featured(spark, sf_dir)).select("seq", "service", "recon_error", "recon_outlier")


@query("t07_ml_log_anomalies")
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.log_features(relation(spark, sf_dir, "logs").select("seq", "service", "ts", "message"), text=False).select("seq", "service", "ts", "features")
    scored = T.log_model_scores(rows, "service", order=newest())
    return T.ml_log_anomalies(scored, ["iso", "lof", "dbscan", "reconstruction"]).select("pattern_name", "service", "seq", "score", "severity", "is_anomaly")


def keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Metrics under their key of service and metric, and the newest of each key that has enough to train on."""
    rows = relation(spark, sf_dir, "metrics").withColumn("metric_key", F.concat_ws("_", "metric_name", "service"))
    return rows, A.training_window(rows, ["metric_key"], newest())


@query("a04_isolation_forest")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, window = keyed(spark, sf_dir)
    models = T.fit_forests(window, "metric_key", F.array("value"), order=newest())
    return T.isolation_forest(rows, "metric_key", F.array("value"), models=models).select("seq", "metric_name", "iso_score", "iso_outlier")


@query(
    "a05_local_outlier_factor",
    """with r as (select seq, metric_name as m, service as s, value as v, row_number() over (partition by metric_name, service order by value, seq) as i from {metrics}),
       nn as (select m, s, i, j, d from (select a.m, a.s, a.i, b.i as j, abs(a.v - b.v) as d, row_number() over (partition by a.m, a.s, a.i order by abs(a.v - b.v), abs(a.i - b.i), b.i) as k from r a join r b on a.m = b.m and a.s = b.s and a.i <> b.i) z where k <= 20),
       kd as (select m, s, i, max(d) as kd from nn group by 1, 2, 3), dens as (select nn.m, nn.s, nn.i, case when sum(greatest(d, kd)) > 0 then count(*) / sum(greatest(d, kd)) else cast('infinity' as double) end as l from nn join kd on kd.m = nn.m and kd.s = nn.s and kd.i = nn.j group by 1, 2, 3),
       f as (select nn.m, nn.s, nn.i, case when max(own.l) = cast('infinity' as double) then 1.0 else avg(other.l / own.l) end as lof from nn join dens own on own.m = nn.m and own.s = nn.s and own.i = nn.i join dens other on other.m = nn.m and other.s = nn.s and other.i = nn.j group by 1, 2, 3)
       select r.seq, r.m as metric_name, round(f.lof, 5) as lof from r left join f on f.m = r.m and f.s = r.s and f.i = r.i""",
)
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lof_1d(relation(spark, sf_dir, "metrics"), ["metric_name", "service"], tie=["seq"]).select("seq", "metric_name", F.round("lof", 5).alias("lof"))


@query("a06_cluster_outlier_factor")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, window = keyed(spark, sf_dir)
    models = T.fit_key_centres(window, "metric_key", F.array("value"), order=newest())
    return T.key_cluster_outlier_factor(rows, "metric_key", F.array("value"), models=models).select("seq", "metric_name", "cblof")


@query(
    "a07_best_model",
    "select seq, round(greatest(least(1.0, value / 200), least(1.0, seq % 10 / 10.0)), 6) as score, case when least(1.0, value / 200) >= least(1.0, seq % 10 / 10.0) then 'a' else 'b' end as model_name, greatest(least(1.0, value / 200), least(1.0, seq % 10 / 10.0)) > 0.7 as is_anomaly from {metrics}",
)
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1.0)
    rows = relation(spark, sf_dir, "metrics").select("seq", F.least(one, F.col("value") / 200).alias("a"), F.least(one, F.col("seq") % 10 / 10.0).alias("b"))
    return A.best_model(rows, ["a", "b"]).select("seq", F.round("score", 6).alias("score"), "model_name", "is_anomaly")


@query("v01_graph_views", "select node_id, name, kind from {geo_nodes} where node_id in (select target from {geo_edges})")
def v01(spark: SparkSession, sf_dir: str) -> DataFrame:
    V.graph_views(relation(spark, sf_dir, "geo_nodes"), relation(spark, sf_dir, "geo_edges"))
    return spark.sql("select node_id, name, kind from graph_nodes where node_id in (select target from graph_edges)")


@query("v02_graph_health", "select (select count(*) from {geo_nodes}) as n_nodes, (select count(*) from {geo_edges}) as n_edges")
def v02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.graph_health(relation(spark, sf_dir, "geo_nodes"), relation(spark, sf_dir, "geo_edges"))


MEASURED = "select n.node_id, case when s_suppkey % 2 = 0 then s_acctbal / 10000 end as cpu_usage, case when s_suppkey % 3 = 0 then s_acctbal end as memory_usage from {geo_nodes} n left join {supplier} on n.name = 'supplier-' || s_suppkey"


@query("v03_services_with_metrics", f"select * from ({MEASURED}) x where coalesce(cpu_usage, memory_usage) is not null")
def v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.services_with_metrics(spark.sql(MEASURED, geo_nodes=relation(spark, sf_dir, "geo_nodes"), supplier=relation(spark, sf_dir, "supplier")))


@query("v04_service_metrics", f"select * from ({MEASURED}) x where node_id like '%/supplier-6'")
def v04(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.sql(MEASURED, geo_nodes=relation(spark, sf_dir, "geo_nodes"), supplier=relation(spark, sf_dir, "supplier"))
    wanted = nodes.where("node_id like '%/supplier-6'").first()["node_id"]
    return V.service_metrics(nodes, wanted)


@query("v05_issue_list", "select issue_id, type, severity, service from {issues} where severity >= 4")
def v05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "issues").where("severity >= 4").select("issue_id", "type", "severity", "service")


STATUS = "select severity, case when issue_id % 3 = 0 then 'mitigated' else 'detected' end as status from {issues}"


@query("v06_overall_status", f"select 'critical' as status, count(*) filter (where severity >= 4) as n_critical, count(*) filter (where severity in (2, 3)) as n_warning, count(*) filter (where severity >= 4) || ' critical issues' as message from ({STATUS}) x where status <> 'mitigated'")
def v06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.overall_status(spark.sql(STATUS, issues=relation(spark, sf_dir, "issues")))


KINDS = "select source, target, confidence, case emit_seq % 4 when 0 then 'ml-inferred' when 1 then 'traffic-inferred' else type end as type from {geo_edges}"


@query("v07_graph_statistics", f"select (select count(*) from {{geo_nodes}}) as n_nodes, count(*) as n_edges, count(*) filter (where contains(type, 'inferred')) as n_inferred, round(avg(coalesce(confidence, 0)), 6) as mean_confidence from ({KINDS}) x")
def v07(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.graph_statistics(relation(spark, sf_dir, "geo_nodes"), spark.sql(KINDS, geo_edges=relation(spark, sf_dir, "geo_edges")))
    return out.withColumn("mean_confidence", F.round("mean_confidence", 6))


STARTED = "select event_id as seq, ts as started, case when event_id % 3 = 0 then 3600 * 24 * 7 when event_id % 3 = 1 then 3600 end as duration from {events}"


@query("v08_remediation_progress", f"select seq, cast(greatest(0, least(100, floor((epoch(timestamp '2024-01-31') - floor(epoch(started))) / coalesce(duration, 60) * 100))) as integer) as progress from ({STARTED}) x")
def v08(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = spark.sql(STARTED, events=relation(spark, sf_dir, "events"))
    return V.remediation_progress(attempts, datetime.datetime(2024, 1, 31)).select("seq", "progress")


@query("v08_incident_report", "select count(*) filter (where issue_id % 3 <> 0) as active_issues, 0 as running, cast(100 as double) as mean_progress from {issues}")
def v08_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = spark.sql(STATUS, issues=relation(spark, sf_dir, "issues"))
    attempts = spark.sql(STARTED, events=relation(spark, sf_dir, "events"))
    return V.incident_report(issues, V.remediation_progress(attempts, datetime.datetime(2025, 1, 31)))


@query("u01_custom_pattern", "select seq, 'served' as pattern_name from {logs} where message like '%served%'")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.match_patterns(relation(spark, sf_dir, "logs"), [L.LogPattern("served", "served$", 1, 10.0)]).select("seq", "pattern_name")


class RangeDetector:
    """Values outside the range of history."""

    def fit(self, history: DataFrame) -> DataFrame:
        return history.groupBy(F.col("metric_name").alias("m")).agg(F.min("value").alias("low"), F.max("value").alias("high"))

    def score(self, rows: DataFrame, model: DataFrame) -> DataFrame:
        return rows.join(model, F.col("metric_name") == F.col("m")).withColumn("is_anomaly", (F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))


@query("u02_custom_detector", "with m as (select metric_name, min(value) as low, max(value) as high from {metrics} where seq % 2 = 0 group by 1) select seq, value < low or value > high as is_anomaly from {metrics} join m using (metric_name) where seq % 2 = 1")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = relation(spark, sf_dir, "metrics")
    return V.detect_with(RangeDetector(), metrics.where("seq % 2 = 0"), metrics.where("seq % 2 = 1")).select("seq", "is_anomaly")


class FrequencyLearner:
    """The action used most for an issue type."""

    name = "frequency"

    def predict(self, available: DataFrame, experiences: DataFrame) -> DataFrame:
        counts = experiences.groupBy("issue_type", "action_id").agg(F.count("*").alias("n"))
        total = counts.groupBy("issue_type").agg(F.max_by(F.struct("action_id", "n"), F.struct("n", "action_id")).alias("b"), F.sum("n").alias("t"))
        return available.select("state_id", "issue_type").distinct().join(total, "issue_type").select("state_id", F.col("b.action_id").alias("action_id"), (F.col("b.n") / F.col("t")).alias("confidence"))


@query(
    "u03_custom_learner",
    "with c as (select issue_type, action_id, count(*) as n from {experiences} group by 1, 2), b as (select issue_type, arg_max(action_id, (n, action_id)) as action_id, max(n) / sum(n) as confidence from c group by 1) select x.seq as state_id, b.action_id, round(b.confidence, 6) as confidence, 'frequency' as learner from {experiences} x join b using (issue_type)",
)
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    experiences = relation(spark, sf_dir, "experiences")
    states = experiences.select(F.col("seq").alias("state_id"), "issue_type", F.array("service").alias("affected_services"))
    available = E.available_actions(states, relation(spark, sf_dir, "actions"))
    out = E.recommend_action(V.predict_with([FrequencyLearner()], available, experiences), available)
    return out.select("state_id", "action_id", F.round("confidence", 6).alias("confidence"), "learner")


@query("u04_custom_policy", "select issue_id, 'page_on_call' as policy from {issues} where severity = 5")
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [("page_on_call", "page", "page ${SERVICE}", None, 10, 1, 10, None, None, None, 5, 0.9, True)]
    return E.match_issue_policies(relation(spark, sf_dir, "issues"), E.policy_table(spark, own))


W100 = "w as (partition by service, metric_name order by ts, seq rows between 99 preceding and current row)"


@query(
    "x01_rolling_scores",
    f"""with r as (select *, avg(value) over w as m, stddev_samp(value) over w as s, quantile_cont(value, 0.25) over w as q1, quantile_cont(value, 0.75) over w as q3, mad(value) over w as d, quantile_cont(value, 0.5) over w as q2 from {{metrics}} window {W100})
        select seq, round((value - m) / s, 5) as rolling_z, coalesce(abs((value - m) / s) > 3, false) as is_z, value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1) as is_iqr, coalesce(abs(value - q2) / nullif(d, 0) > 3, false) as is_mad from r""",
)
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.rolling_scores(relation(spark, sf_dir, "metrics"), ["service", "metric_name"], ["ts", "seq"])
    return out.select("seq", F.round("rolling_z", 5).alias("rolling_z"), "is_z", "is_iqr", "is_mad")


@query(
    "x02_temporal_groups",
    """with recursive e as (select service, ts, row_number() over (partition by service order by ts) as i from (select distinct service, ts from {logs}) d),
       g as (select service, ts, i, ts as group_start from e where i = 1 union all select e.service, e.ts, e.i, case when e.ts - g.group_start > interval 300 second then e.ts else g.group_start end from g join e on e.service = g.service and e.i = g.i + 1)
       select l.seq, cast(epoch(g.group_start) as bigint) as group_start from {logs} l join g on g.service = l.service and g.ts = l.ts""",
)
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.temporal_groups(relation(spark, sf_dir, "logs"), "service")
    return out.select("seq", F.unix_timestamp(F.col("group_start").cast("timestamp")).alias("group_start"))


NODE_EVENTS = "select n.node_id, date_trunc('day', a.ts) as group_start from {anomalies} a join {trade_nodes} n on n.seq = a.seq % 25"


@query(
    "x03_spatial_groups",
    f"""with recursive m as (select distinct cast(group_start as timestamp) as g, node_id from ({NODE_EVENTS}) x), u as (select source as a, target as b from {{trade_edges}} union select target, source from {{trade_edges}}),
        hop as (select g, node_id as n0, node_id as t from m union select h.g, h.n0, u.b from hop h join u on u.a = h.t join m on m.g = h.g and m.node_id = u.b)
        select cast(epoch(g) as bigint) as group_start, n0 as node_id, min(t) as component from hop group by 1, 2""",
)
def x03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(NODE_EVENTS, anomalies=relation(spark, sf_dir, "anomalies"), trade_nodes=relation(spark, sf_dir, "trade_nodes"))
    out = X.spatial_groups(rows, relation(spark, sf_dir, "trade_edges"))
    return out.select(F.unix_timestamp(F.col("group_start").cast("timestamp")).alias("group_start"), "node_id", "component")


@query(
    "x04_criticality",
    """with recursive e as (select distinct source, target from {geo_edges}), r as (select source as a, target as b from e union select r.a, e.target from r join e on e.source = r.b)
       select n.node_id, round(0.4e0 * (select count(*) from e where target = n.node_id) * (select count(*) from e where source = n.node_id) + 0.3e0 * (select count(*) from r where a = n.node_id and b <> a) + 0.3e0 * (select count(*) from r where b = n.node_id and b <> a), 6) as criticality from {geo_nodes} n""",
)
def x04(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = geo(spark, sf_dir)
    return X.criticality(nodes, edges).select("node_id", F.round("criticality", 6).alias("criticality"))


@query(
    "x05_template_frequency",
    """with c as (select date_trunc('hour', ts) as hour, message as template, count(*) as n from {logs} group by 1, 2), z as (select *, (n - avg(n) over w) / greatest(stddev_pop(n) over w, 0.1) as z from c window w as (partition by template order by hour rows between 24 preceding and 1 preceding))
       select cast(epoch(hour) as bigint) as hour, template, n, round(z, 6) as z, coalesce(abs(z) > 3, false) as is_anomaly from z""",
)
def x05(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.template_frequency(relation(spark, sf_dir, "logs"), "message")
    return out.select(F.unix_timestamp("hour").alias("hour"), "template", "n", F.round("z", 6).alias("z"), "is_anomaly")


SCORES = "select seq, value / 500 as a, seq % 7 / 7e0 as b, seq % 3 / 3e0 as c, case when seq % 2 = 0 then 0.5e0 end as d from {metrics}"


@query("x06_weighted_ensemble", f"with t as (select seq, a + 1.2e0 * b + 1.5e0 * c + 0.8e0 * coalesce(d, 0) as t from ({SCORES}) x) select seq, round(t / max(t) over (), 6) as ensemble, t > (select quantile_cont(t, 0.99) from t) as is_anomaly from t")
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(SCORES, metrics=relation(spark, sf_dir, "metrics"))
    return X.weighted_ensemble(rows, {"a": 1.0, "b": 1.2, "c": 1.5, "d": 0.8}).select("seq", F.round("ensemble", 6).alias("ensemble"), "is_anomaly")


@query(
    "x07_graph_features",
    """with e as (select distinct source, target from {trade_edges} where source <> target), u as (select source as a, target as b from e union select target, source from e), k as (select a, count(*) as d from u group by a),
       t as (select x.a, count(*) as t from u x join u y on x.a = y.a and x.b < y.b join u z on z.a = x.b and z.b = y.b group by x.a)
       select n.node_id, (select count(*) from e where target = n.node_id) as in_degree, (select count(*) from e where source = n.node_id) as out_degree, round(case when k.d > 1 then 2.0 * coalesce(t.t, 0) / (k.d * (k.d - 1)) else 0 end, 6) as clustering,
       round((select count(*) from e) / (25.0 * 24), 6) as density from {trade_nodes} n left join k on k.a = n.node_id left join t on t.a = n.node_id""",
)
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.graph_features(relation(spark, sf_dir, "trade_nodes"), relation(spark, sf_dir, "trade_edges"))
    return out.select("node_id", F.col("in_degree").cast("long").alias("in_degree"), F.col("out_degree").cast("long").alias("out_degree"), F.round("clustering", 6).alias("clustering"), F.round("density", 6).alias("density"))


@query(
    "x07_page_rank",
    """with recursive st as (select distinct source, target from {geo_edges}), od as (select source, count(*) as n from st group by 1), c as (select count(*) as n from {geo_nodes}),
       pr as (select 0 as i, node_id, 1.0e0 / c.n as rank from {geo_nodes}, c
              union all select i + 1, node_id, rank from (
                  select r.i, r.node_id, 0.15e0 / max(c.n) + 0.85e0 * max(l.lost) / max(c.n) + 0.85e0 * coalesce(sum(s.rank / od.n), 0) as rank
                  from pr r cross join c cross join (select coalesce(sum(rank), 0) as lost from pr where node_id not in (select source from od)) l
                  left join st on st.target = r.node_id left join pr s on s.node_id = st.source left join od on od.source = st.source
                  where r.i < 30 group by r.i, r.node_id) z)
       select node_id, round(rank, 9) as rank from pr where i = 30""",
)
def x07_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.operators.graph_algo import page_rank

    return page_rank(*geo(spark, sf_dir)).select("node_id", F.round("rank", 9).alias("rank"))


MOVES = "select o_orderpriority as state, o_orderstatus as action, o_totalprice / 500000 as reward, lead(o_orderpriority) over (partition by o_custkey order by o_orderdate, o_orderkey) as next_state from {orders}"


@query(
    "x08_fitted_q",
    f"""with recursive g as (select state, action, next_state, sum(reward) as r, count(*) as n from ({MOVES}) m group by 1, 2, 3),
        qv as (select 0 as i, state, action, 0.0e0 as q, 1.0e9 as change from (select distinct state, action from g) s
               union all select i + 1, state, action, nq, max(abs(nq - q)) over () from (
                   select v.i, v.state, v.action, v.q, sum(g.r + 0.9e0 * g.n * coalesce(b.best, 0)) / sum(g.n) as nq
                   from qv v join g on g.state = v.state and g.action = v.action left join (select state as ns, max(q) as best from qv group by state) b on b.ns = g.next_state
                   where v.change >= 1e-4 and v.i < 200 group by 1, 2, 3, 4) z)
        select state, action, round(q, 6) as q from qv where i = (select max(i) from qv)""",
)
def x08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(MOVES, orders=relation(spark, sf_dir, "orders"))
    return X.fitted_q(rows).withColumn("q", F.round("q", 6))


@query("x09_calendar_baselines", "select metric_name, cast(hour(ts) as integer) as hour, cast(dayofweek(ts) + 1 as integer) as weekday, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, count(*) as n from {metrics} group by 1, 2, 3")
def x09(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.calendar_baselines(relation(spark, sf_dir, "metrics"))
    return out.select("metric_name", "hour", "weekday", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")
