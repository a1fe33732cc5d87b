"""Streams over batches that come out of order, sinks that fail, and marks that outlive a restart."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lantern.operators import logs as L
from lantern.plans.more import _collect
from lantern.sources import sinks
from lantern.streaming import streams as W

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "seq long, ts timestamp, service string, message string"


def staged(spark, folder, batches):
    """Each batch is a file of its own, in order."""
    for batch in batches:
        rows = [(seq, START + datetime.timedelta(seconds=s), "a", "boom") for seq, s in batch]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def trailing(batches, window, least):
    """Counts by plain loops: lines so far, this one included, from a window before it on."""
    seen, out = [], {}
    for batch in batches:
        for seq, s in sorted(batch, key=lambda x: (x[1], x[0])):
            seen.append(s)
            n = sum(s - window <= x <= s for x in seen)
            if n > least:
                out[seq] = n
    return out


@pytest.mark.parametrize(
    "batches",
    [
        [[(1, 400)], [(2, 150)], [(3, 480)]],
        [[(1, 10), (2, 10), (3, 500)], [(4, 250), (5, 310), (6, 310)], [(7, 300), (8, 520), (9, 220)], [(10, 521)]],
    ],
)
def test_counts_of_lines_out_of_order(spark, tmp_path, batches):
    pattern = L.LogPattern(name="boom", regex="boom", severity=2, threshold=0.5, window_seconds=300)
    out = _collect(W.stream_pattern_anomalies(staged(spark, str(tmp_path / "in"), batches), [pattern], delay="1000 seconds")).collect()
    assert {r["seq"]: r["count"] for r in out} == trailing(batches, 300, 0.5)
    assert all(r["score"] == pytest.approx(min(1.0, (r["count"] / 0.5 - 1) / 9)) for r in out)
    if len(batches) == 3:
        assert [r["count"] for r in sorted(out, key=lambda r: r["seq"])] == [1, 1, 2]


def test_lines_in_order_count_as_in_a_table(spark, tmp_path):
    batches = [[(i * 10 + j, i * 100 + j * 7) for j in range(10)] for i in range(5)]
    pattern = L.LogPattern(name="boom", regex="boom", severity=2, threshold=0.5, window_seconds=300)
    out = _collect(W.stream_pattern_anomalies(staged(spark, str(tmp_path / "in"), batches), [pattern])).collect()
    rows = spark.createDataFrame([(seq, START + datetime.timedelta(seconds=s), "a", "boom") for b in batches for seq, s in b], SCHEMA)
    table = L.detect(rows, [pattern]).collect()
    assert {(r["seq"], r["count"]) for r in out} == {(r["seq"], r["count"]) for r in table} and len(out) == 50


@pytest.mark.parametrize("slots", [1, 2, 3, 16])
def test_counts_over_many_slots_equal_plain_loops(spark, tmp_path, slots):
    draw = random.Random(slots)
    # Ends of buckets, ties and lines a whole window apart are all there.
    at = [draw.choice([300 * draw.randrange(8), 300 * draw.randrange(8) + draw.choice([-1, 1, 150]) + 1]) for _ in range(240)]
    batches = [[(80 * b + i, at[80 * b + i]) for i in range(80)] for b in range(3)]
    pattern = L.LogPattern(name="boom", regex="boom", severity=2, threshold=3.0, window_seconds=300)
    stream = W.stream_pattern_anomalies(staged(spark, str(tmp_path / "in"), batches), [pattern], delay="10000 seconds", slots=slots)
    out = _collect(stream).collect()
    assert len(out) == len({r["seq"] for r in out}) and {r["seq"]: r["count"] for r in out} == trailing(batches, 300, 3.0)


def test_no_slot_keeps_a_whole_pattern(spark, tmp_path):
    # One batch over 64 windows, as of a stream that catches up: the second one finds what each slot kept.
    batches = [[(i, i * 10) for i in range(64 * 30)], [(5000, 64 * 300)]]
    pattern = L.LogPattern(name="boom", regex="boom", severity=2, threshold=3.0, window_seconds=300)
    state = str(tmp_path / "state")
    stream = W.stream_pattern_anomalies(staged(spark, str(tmp_path / "in"), batches), [pattern], delay="100000 seconds")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.format("statestore").load(state).selectExpr("key.*", "value.*")
    held = [r[0] for r in kept.selectExpr("aggregate(groupState.numbers, 0L, (a, x) -> a + x)").collect()]
    assert len(held) == 16 and max(held) <= 2 * 64 * 30 / 16 + 1 and sum(held) == 2 * (64 * 30 + 1)


def test_late_lines_are_counted(spark, tmp_path):
    pattern = L.LogPattern(name="boom", regex="boom", severity=2, threshold=0.5, window_seconds=300)
    batches = [[(1, 5000)], [(2, 5001)], [(3, 10), (4, 20)], [(5, 5002)]]
    out = _collect(W.stream_pattern_anomalies(staged(spark, str(tmp_path / "in"), batches), [pattern])).collect()
    assert sorted(r["seq"] for r in out) == [1, 2, 5] and sum(r["n_late"] for r in out) == 2


def test_a_failed_sink_stops_the_stream_and_its_batch_comes_again(spark, tmp_path):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    batches = [[(1, 0)], [(2, 1)], [(3, 2)]]
    down = [True]

    def fails(batch, epoch):
        if epoch == 1 and down[0]:
            raise ValueError("down")

    write = sinks.to_epochs(out)
    stream = staged(spark, folder, batches)
    with pytest.raises(Exception, match="failed"):
        sinks.for_each_result(stream, fails, write, checkpoint=state).awaitTermination()
    # The other callback had the batch all the same; when it comes again no row is there twice.
    assert sorted(r["seq"] for r in spark.read.parquet(out).collect()) == [1, 2]
    down[0] = False
    sinks.for_each_result(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), fails, write, checkpoint=state).awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_the_mark_of_late_rows_outlives_a_restart(spark, tmp_path):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    W.count_late(staged(spark, folder, [[(1, 100_000)]]), "1 hours", out, state).awaitTermination()
    W.count_late(staged(spark, folder, [[(2, 50), (3, 99_000)]]), "1 hours", out, state).awaitTermination()
    total = spark.read.parquet(out).agg(F.sum("n").alias("n"), F.sum("n_late").alias("late")).first()
    assert (total["n"], total["late"]) == (3, 1)
