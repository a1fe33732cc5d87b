"""Queries over log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators import logs as L
from lantern.plans.base import query, relation

#: The catalogue as SQL rows, for the queries' twins.
CATALOGUE = "(values " + ", ".join(f"('{p.name}', '{p.regex}', {p.severity}, cast({p.threshold} as double))" for p in L.DEFAULT_PATTERNS) + ") p(pattern_name, regex, severity, threshold)"
CATALOGUE = CATALOGUE.replace("{", "{{").replace("}", "}}")
MATCHES = f"m as (select l.*, p.pattern_name, p.severity, p.threshold from {{logs}} l join {CATALOGUE} on regexp_matches(l.message, p.regex))"
COUNTED = MATCHES + """, c as (select a.*, (select count(*) from m b where b.pattern_name = a.pattern_name and b.ts <= a.ts and b.ts >= a.ts - interval 300 second
    and (b.ts < a.ts or b.seq <= a.seq)) as n_in_window from m a)"""
SCORED = COUNTED + """, s as (select *, least(n_in_window, 10001) as n, case when n_in_window / threshold <= 1 then 0.0 else least(1.0, (n_in_window / threshold - 1) / 9) end as score from c)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.detect(relation(spark, sf_dir, "logs"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("pattern_name", "service", "seq", "count", F.round("score", 6).alias("score"), "severity", "is_anomaly")


OUT = "pattern_name, service, seq, n as count, round(score, 6) as score, severity, score > 0.5 as is_anomaly"


@query("l01_match_patterns", f"with {MATCHES} select seq, pattern_name, severity, threshold from m")
def l01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.match_patterns(relation(spark, sf_dir, "logs")).select("seq", "pattern_name", "severity", "threshold")


@query("l02_windowed_count", f"with {COUNTED} select seq, pattern_name, n_in_window from c")
def l02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.windowed_count(L.match_patterns(relation(spark, sf_dir, "logs"))).select("seq", "pattern_name", "n_in_window")


@query("l03_anomaly_score", f"with {SCORED} select {OUT} from s where score > 0")
def l03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_found(spark, sf_dir))


@query(
    "l04_log_samples",
    f"""with {SCORED}, w as (select a.seq, a.pattern_name, b.message, row_number() over (partition by a.seq, a.pattern_name order by b.ts, b.seq) as i
        from s a join m b on b.pattern_name = a.pattern_name and b.ts <= a.ts and b.ts >= a.ts - interval 300 second where a.score > 0)
        select seq, pattern_name, string_agg(message, '|' order by i) as log_samples from w where i <= 10 group by seq, pattern_name""",
)
def l04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.detect(relation(spark, sf_dir, "logs"), samples=True).select("seq", "pattern_name", F.array_join("log_samples", "|").alias("log_samples"))


@query("l05_newest_anomalies", f"with {SCORED} select {OUT} from s where score > 0 order by ts desc, seq desc, pattern_name limit 1000")
def l05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(L.newest_anomalies(_found(spark, sf_dir)))


@query("l07_get_anomalies", f"with {SCORED} select {OUT} from s where score >= 0.05 and severity >= 3 and service = 'svc-3' and ts >= timestamp '2024-01-10 00:00:00'")
def l07(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    return _rounded(L.get_anomalies(_found(spark, sf_dir), since=datetime.datetime(2024, 1, 10), service="svc-3", min_severity=3, min_score=0.05))


@query("l08_anomaly_count", f"with {SCORED} select count(*) as n_anomalies from s where score >= 0.1 and severity >= 1")
def l08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.get_anomaly_count(_found(spark, sf_dir), min_score=0.1)


@query("l09_update_baseline", f"with {SCORED.replace('p.threshold from', '''case p.pattern_name when 'cpu_error' then 0.0 when 'http_5xx' then 1.0 else p.threshold end as threshold from''').replace('case when n_in_window / threshold <= 1', 'case when threshold = 0 then 1.0 when n_in_window / threshold <= 1')} select {OUT} from s where score > 0")
def l09(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = L.update_baseline(L.update_baseline(L.update_baseline(L.DEFAULT_PATTERNS, "cpu_error", 0.0), "http_5xx", 1.0), "unknown", 9.0)
    return _rounded(L.detect(relation(spark, sf_dir, "logs"), patterns))


@query(
    "l10_pattern_hits",
    f"with {MATCHES} select pattern_name, service, count(*) as n from m group by pattern_name, service",
)
def l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.match_patterns(relation(spark, sf_dir, "logs")).groupBy("pattern_name", "service").agg(F.count("*").alias("n"))


RAW = "case seq % 4 when 0 then '[' || service || '-ab12-x9] ' || message when 1 then '{{\"service\": \"' || service || '\", \"m\": 1}}' when 2 then service || ': ' || message else message end"


@query("l12_extract_service", "select seq, case seq % 4 when 3 then case when message like '%:%' then split_part(message, ':', 1) else 'default' end else service end as found from {logs}")
def l12(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = relation(spark, sf_dir, "logs").withColumn("line", F.expr(RAW.replace("{{", "{").replace("}}", "}")))
    return lines.select("seq", L.extract_service(F.col("line")).alias("found"))


@query("s03_union_logs", "select seq, service, level from {logs} where level = 'ERROR' union all select seq, service, level from {logs} where level = 'WARN'")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = relation(spark, sf_dir, "logs")
    return L.union_logs(logs.where("level = 'ERROR'"), logs.where("level = 'WARN'").drop("message")).select("seq", "service", "level")


@query("s04_log_buffer", "select seq, service from (select * from {logs} order by ts desc, seq desc limit 1000) b where ts >= timestamp '2024-01-01 00:00:00' order by ts desc, seq desc limit 100")
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    return L.log_buffer(relation(spark, sf_dir, "logs"), count=100, since=datetime.datetime(2024, 1, 1)).select("seq", "service")
