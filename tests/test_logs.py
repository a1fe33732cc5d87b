import datetime
import random

from lantern.operators import logs as L
from lantern.operators.logs import LogPattern

T0 = datetime.datetime(2024, 1, 1, 12)
COLUMNS = "seq long, ts timestamp, service string, level string, message string"


def lines(spark, rows):
    return spark.createDataFrame([(i, T0 + datetime.timedelta(seconds=s), "svc", "INFO", m) for i, (s, m) in enumerate(rows)], COLUMNS)


def test_windowed_count_is_the_trailing_count(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(900), rng.choice(["hit", "other"])) for _ in range(400)]
    rows.sort(key=lambda r: r[0])
    found = {r["seq"]: r["n_in_window"] for r in L.windowed_count(L.match_patterns(lines(spark, rows), [LogPattern("p", "hit", 1, 1.0)])).collect()}
    hits = [(i, s) for i, (s, m) in enumerate(rows) if m == "hit"]
    assert found == {i: sum(1 for j, t in hits if s - 300 <= t <= s and (t < s or j <= i)) for i, s in hits}


def test_windows_of_several_lengths(spark):
    patterns = [LogPattern("short", "hit", 1, 1.0, window_seconds=10), LogPattern("long", "hit", 1, 1.0, window_seconds=100)]
    rows = [(0, "hit"), (50, "hit"), (55, "hit")]
    found = {(r["pattern_name"], r["seq"]): r["n_in_window"] for r in L.windowed_count(L.match_patterns(lines(spark, rows), patterns), [10, 100]).collect()}
    assert found == {("short", 0): 1, ("short", 1): 1, ("short", 2): 2, ("long", 0): 1, ("long", 1): 2, ("long", 2): 3}


def test_score_edges(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, 0.0), (1, 0.0), (1, 1.0), (2, 1.0), (10, 1.0), (11, 1.0)], "c long, e double")
    scores = [r[0] for r in rows.select(L.anomaly_score(F.col("c"), F.col("e"))).collect()]
    assert [round(x, 4) for x in scores] == [0.0, 1.0, 0.0, 0.1111, 1.0, 1.0]


def test_sample_scenario(spark):
    rows = [(i, "high CPU usage") for i in range(4)] + [(10, "Error one"), (11, "Connection refused"), (12, "code 503"), (13, "fine"), (14, None)]
    found = {(r["pattern_name"], r["count"]): round(r["score"], 4) for r in L.detect(lines(spark, rows)).collect()}
    assert found == {("cpu_error", 2): 0.1111, ("cpu_error", 3): 0.2222, ("cpu_error", 4): 0.3333}


def test_empty(spark):
    assert L.detect(lines(spark, [])).count() == 0
