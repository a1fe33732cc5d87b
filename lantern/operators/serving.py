"""Read queries behind the service's pages, and the surface that users extend."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEASURES = ("cpu_usage", "memory_usage", "request_rate", "error_rate", "latency_p95")
INFERRED = ("ml-inferred", "traffic-inferred", "error-inferred")


def graph_views(nodes: DataFrame, edges: DataFrame) -> None:
    """Temporary views ``graph_nodes`` and ``graph_edges``."""
    nodes.createOrReplaceTempView("graph_nodes")
    edges.createOrReplaceTempView("graph_edges")


def graph_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of nodes and edges."""
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))


def services_with_metrics(nodes: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Nodes that have any of the measures."""
    have = [c for c in measures if c in nodes.columns]
    return nodes.where(F.coalesce(*have).isNotNull())


def service_metrics(nodes: DataFrame, node_id: str, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id).select("node_id", *[c for c in measures if c in nodes.columns])


def overall_status(issues: DataFrame) -> DataFrame:
    """One row: critical with any open issue of severity 4 or 5, a warning with any of 2 or 3, else healthy; with counts and a message."""
    open_issue = F.coalesce(F.col("status") != "mitigated", F.lit(True))
    rows = issues.agg(F.count_if(open_issue & (F.col("severity") >= 4)).alias("n_critical"), F.count_if(open_issue & F.col("severity").isin(2, 3)).alias("n_warning"))
    status = F.when(F.col("n_critical") > 0, "critical").when(F.col("n_warning") > 0, "warning").otherwise("healthy")
    message = F.when(F.col("n_critical") > 0, F.concat(F.col("n_critical").cast("string"), F.lit(" critical issues"))).when(F.col("n_warning") > 0, F.concat(F.col("n_warning").cast("string"), F.lit(" warnings"))).otherwise("All systems operational")
    return rows.select(status.alias("status"), "n_critical", "n_warning", message.alias("message"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, inferred edges and the mean confidence, null counted as 0."""
    inferred = F.coalesce(F.col("type").rlike("|".join(INFERRED)), F.lit(False))
    e = edges.agg(F.count("*").alias("n_edges"), F.count_if(inferred).alias("n_inferred"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("mean_confidence"))
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(e)


def remediation_progress(attempts: DataFrame, at, default_seconds: int = 60) -> DataFrame:
    """``progress`` of each attempt ``started, duration``: whole percents of its duration so far, at most 100."""
    seconds = F.unix_timestamp(F.lit(at)) - F.unix_timestamp(F.col("started").cast("timestamp"))
    share = F.floor(seconds / F.coalesce("duration", F.lit(default_seconds)) * 100)
    return attempts.withColumn("progress", F.greatest(F.lit(0), F.least(F.lit(100), share)).cast("int"))


def incident_report(issues: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row: open issues, running attempts and their mean progress."""
    i = issues.agg(F.count_if(F.col("status") != "mitigated").alias("active_issues"))
    a = attempts.agg(F.count_if(F.col("progress") < 100).alias("running"), F.coalesce(F.avg("progress"), F.lit(0.0)).alias("mean_progress"))
    return i.crossJoin(a)


class Detector(Protocol):
    """A detector of one's own: learn a model table from history, then score rows with it."""

    def fit(self, history: DataFrame) -> DataFrame: ...

    def score(self, rows: DataFrame, model: DataFrame) -> DataFrame: ...


class Learner(Protocol):
    """A learner of one's own: ``state_id, action_id, confidence`` for available actions, from all experience."""

    name: str

    def predict(self, available: DataFrame, experiences: DataFrame) -> DataFrame: ...


def detect_with(detector: Detector, history: DataFrame, rows: DataFrame) -> DataFrame:
    return detector.score(rows, detector.fit(history))


def predict_with(learners: list[Learner], available: DataFrame, experiences: DataFrame) -> DataFrame:
    """The predictions of all learners in their order, for ``recommend_action``."""
    out = None
    for i, learner in enumerate(learners):
        one = learner.predict(available, experiences).select("state_id", "action_id", "confidence", F.lit(learner.name).alias("learner"), F.lit(i).alias("learner_seq"))
        out = one if out is None else out.union(one)
    return out
