"""Streaming forms of the log, metric and incident operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lantern.operators import logs as L
from lantern.operators import metrics as A
from lantern.operators import prom as P
from lantern.operators import remediation as E
from lantern.sources.sinks import epochs, for_each_result, to_epochs

ANOMALY = "pattern_name string, service string, seq long, ts timestamp, count long, score double, severity int, n_late long"


def _score(count: int, expected: float) -> float:
    if expected == 0:
        return 1.0 if count > 0 else 0.0
    ratio = count / expected
    return 0.0 if ratio <= 1 else min(1.0, (ratio - 1) / 9)


def stream_pattern_anomalies(logs: DataFrame, patterns: Sequence[L.LogPattern] = L.DEFAULT_PATTERNS, delay: str | None = None, by: Sequence[str] = ("pattern_name",), slots: int = 16) -> DataFrame:
    """Anomalies of lines as they come: the exact trailing count of each line's pattern, and its score.

    A line counts those of its pattern in [t - window, t] that have come up to it; lines of one batch come
    in the order of time and ``seq``. Time is cut into buckets of a window's length, dealt in turn to
    ``slots``: a line goes to the slot of its own bucket, which counts it, and to that of the next, whose
    lines may count it. So a batch of a frequent pattern, as when a stream catches up, goes to many tasks,
    and no state holds a whole pattern. The state of a slot is the distinct times, in order, of the lines
    that a later one may count, with their numbers: those from a window before the watermark on.

    A line older than the watermark, by default the longest window behind, is dropped and counted in
    ``n_late`` of its slot's next anomaly; state has no timeout, as Spark would drop such lines unseen, and
    a slot comes round again. ``by`` may add the service for more parallel keys, which makes the counts per service.
    """
    known = {p.name: p for p in patterns}
    wait = delay or f"{max(p.window_seconds for p in patterns)} seconds"
    rows = L.match_patterns(logs, patterns).select("pattern_name", "service", "seq", F.col("ts").cast("timestamp").alias("ts"), "window_seconds").withWatermark("ts", wait)
    bucket = F.floor(F.unix_micros("ts") / (F.greatest("window_seconds", F.lit(1)) * 1_000_000)).cast("long")
    slot = lambda b: F.pmod(b, F.lit(slots)).cast("int")
    dealt = rows.withColumn("home", slot(bucket)).withColumn("slot", F.explode(F.array_distinct(F.array(slot(bucket), slot(bucket + 1)))))
    dealt = dealt.select("pattern_name", "service", "seq", "ts", (F.col("home") == F.col("slot")).alias("own"), "slot")

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = known[key[0]]
        times, numbers, late = state.get if state.exists else ([], [], 0)
        times, numbers = np.array(times, dtype=np.int64), np.array(numbers, dtype=np.int64)
        mark, window = state.getCurrentWatermarkMs() * 1000, p.window_seconds * 1_000_000
        pdf = pd.concat(list(frames)).sort_values(["ts", "seq"])
        us = ((pdf["ts"] - pd.Timestamp(0)) // pd.Timedelta(microseconds=1)).to_numpy(dtype=np.int64)
        late += int(((us < mark) & pdf["own"]).sum())
        pdf, us = pdf[us >= mark], us[us >= mark]
        before = np.concatenate([[0], np.cumsum(numbers)])
        old = before[np.searchsorted(times, us, "right")] - before[np.searchsorted(times, us - window, "left")]
        own = np.arange(1, len(us) + 1) - np.searchsorted(us, us - window, "left")
        n = np.minimum(old + own, L.MAX_HISTORY + 1)
        score = np.array([_score(int(x), p.threshold) for x in n])
        out = pdf[["service", "seq", "ts"]].assign(pattern_name=p.name, count=n, score=score, severity=p.severity, n_late=0)[(score > 0) & pdf["own"].to_numpy(dtype=bool)]
        if len(out):
            out.iloc[0, out.columns.get_loc("n_late")] = late
            late = 0
        times, place = np.unique(np.concatenate([times, us]), return_inverse=True)
        numbers = np.bincount(place, np.concatenate([numbers, np.ones(len(us))]), minlength=len(times)).astype(np.int64)
        stays = times >= mark - window
        state.update((times[stays].tolist(), numbers[stays].tolist(), late))
        yield out[["pattern_name", "service", "seq", "ts", "count", "score", "severity", "n_late"]]

    return dealt.groupBy(*by, "slot").applyInPandasWithState(count, ANOMALY, "times array<long>, numbers array<long>, late long", "append", GroupStateTimeout.NoTimeout)


def stream_pattern_counts(logs: DataFrame, patterns: Sequence[L.LogPattern] = L.DEFAULT_PATTERNS, window: str = "300 seconds", slide: str = "30 seconds", delay: str = "300 seconds") -> DataFrame:
    """``start, pattern_name, n, score`` per sliding window: the form for very many lines.

    Windows are half open and lie on a grid, so counts are near those of each line's own window.
    Counts are summed per task before they are shuffled, so a frequent pattern is no hot key.
    """
    rows = L.match_patterns(logs, patterns).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = rows.groupBy(F.window("ts", window, slide).alias("w"), "pattern_name", "threshold").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "pattern_name", "n", L.anomaly_score(F.col("n"), F.col("threshold")).alias("score"))


def stream_zscore(wide: DataFrame, baseline: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Rows of a stream scored against a saved baseline of one row."""
    return A.detect_zscore(wide, baseline, columns, threshold)


def health_batch(batch: DataFrame, names: dict[str, str]) -> DataFrame:
    """The latest value of each measure per service in a batch, and the health that follows; ``names`` map measures to metrics."""
    latest = P.latest(batch, ["service", "metric_name"], tie=["seq"])
    wide = latest.groupBy("service").agg(*[F.max(F.when(F.col("metric_name") == metric, F.col("value"))).alias(m) for m, metric in names.items()])
    return wide.withColumn("health_status", P.health_status(*[F.col(m) for m in ("error_rate", "latency_p95", "cpu_usage", "memory_usage")]))


def stream_health(samples: DataFrame, names: dict[str, str], path: str, checkpoint: str, trigger: dict | None = None):
    """Health of services batch by batch, in ``path`` by ``epoch``; every minute unless a trigger is given."""
    return for_each_result(samples, to_epochs(path, lambda batch: health_batch(batch, names)), checkpoint=checkpoint, trigger=trigger or {"processingTime": "60 seconds"})


def incident_batch(flagged: DataFrame, actions: DataFrame, confidence: DataFrame) -> DataFrame:
    """Issues of a batch's flagged rows ``seq, service, z_score, is_anomaly, detector, issue_type`` with the action recommended for each."""
    issues = E.anomalies_to_issues(flagged.withColumn("z_score", F.col("z_score")), ["seq"])
    states = flagged.where("is_anomaly").select(F.col("seq").alias("state_id"), "issue_type", F.array(F.concat(F.lit("service/"), "service")).alias("affected_services"))
    predicted = E.predict_action(E.available_actions(states, actions), confidence).withColumn("learner", F.lit("rules"))
    return E.incident_pipeline(issues, predicted, "seq")


def stream_incidents(flagged: DataFrame, actions: DataFrame, confidence: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Incidents of flagged rows batch by batch, in ``path`` by ``epoch``."""
    return for_each_result(flagged, to_epochs(path, lambda batch: incident_batch(batch, actions, confidence)), checkpoint=checkpoint, trigger=trigger)


def count_late(rows: DataFrame, delay: str, path: str, checkpoint: str):
    """``n, n_late, newest`` of each batch in ``path`` by ``epoch``: rows older than ``delay`` before the newest row of earlier batches are late.

    ``newest`` is that of all batches so far and is read from the one before, so it outlives a restart,
    and a batch that is run again counts the same.
    """
    spark = rows.sparkSession

    def run(batch: DataFrame, epoch: int) -> None:
        mark = None
        if epoch > 0 and (folders := epochs(spark, path, epoch)):
            mark = spark.read.parquet(folders[-1]).first()["newest"]
        late = F.lit(False) if mark is None else F.col("ts") < F.lit(mark) - F.expr(f"interval {delay}")
        counted = batch.agg(F.count("*").alias("n"), F.count_if(late).alias("n_late"), F.greatest(F.max("ts"), F.lit(mark)).alias("newest") if mark is not None else F.max("ts").alias("newest"))
        to_epochs(path)(counted, epoch)

    return for_each_result(rows, run, checkpoint=checkpoint)
