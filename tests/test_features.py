"""The vocabulary of log features by plain counting, without a count of every run."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lantern.operators import ml


@pytest.mark.parametrize("terms", [5, 30, 500])
def test_frequent_runs_by_plain_counts(spark, terms):
    rng = random.Random(terms)
    names = [f"w{i}" for i in range(40)]
    texts = [rng.choices(names, [40 / (i + 1) ** 2 for i in range(40)], k=rng.randrange(30)) for _ in range(60)]
    counts = Counter(" ".join(t[i : i + n]) for t in texts for n in (1, 2, 3) for i in range(len(t) - n + 1))
    want = sorted(counts, key=lambda r: (-counts[r], r.count(" "), r))[:terms]
    rows = spark.createDataFrame([(t,) for t in texts], "__w array<string>")
    assert ml._frequent_runs(rows, terms) == want
    assert any(" " in r for r in want) or terms == 5


def test_texts_are_cut_into_words_only_four_times(spark):
    """Once for words, once for longer runs, once for all that is fitted, once for the features."""
    read = spark.sparkContext.accumulator(0)
    lines = [(i, " ".join(random.Random(i).choices("disk full error node pod slow retry".split(), k=9))) for i in range(40)]

    @F.udf("string")
    def told(x):
        read.add(1)
        return x

    rows = spark.createDataFrame(lines, "i int, line string").select("i", told.asNondeterministic()("line").alias("message"))
    found = ml.log_features(rows).select("i", "features").collect()
    assert len(found) == 40 and {len(r["features"]) for r in found} == {10} and read.value <= 4 * 40


def test_without_texts_they_are_read_three_times_for_the_same_features(spark):
    """Once for words, once for longer runs, once for frequencies, which the rows keep."""
    read = spark.sparkContext.accumulator(0)
    lines = [(i, " ".join(random.Random(i).choices("disk full error the node pod slow retry".split(), k=9))) for i in range(40)]

    @F.udf("string")
    def told(x):
        read.add(1)
        return x

    plain = spark.createDataFrame(lines, "i int, message string")
    want = {r["i"]: r["features"] for r in ml.log_features(plain).collect()}
    rows = ml.log_features(plain.select("i", told.asNondeterministic()("message").alias("message")), text=False)
    assert rows.columns == ["i", "features"]
    assert {r["i"]: r["features"] for r in rows.collect()} == {i: pytest.approx(x, abs=1e-9) for i, x in want.items()} and read.value <= 3 * 40


def test_runs_end_with_their_row():
    words = pa.array([["a", "b"], [], None, ["b", "x", "a", "b", "a", "a"], ["b"]])
    row, codes = ml._run_codes(words, ["a", "b"])
    counts = Counter(zip(row.tolist(), codes.tolist(), strict=True))
    # To the base of three: ab = 5, ba = 7, aa = 4, aba = 16, baa = 22.
    assert counts == Counter({(0, 1): 1, (0, 2): 1, (0, 5): 1, (3, 1): 3, (3, 2): 2, (3, 5): 1, (3, 7): 1, (3, 4): 1, (3, 16): 1, (3, 22): 1, (4, 2): 1})


def test_frequencies_are_read_once_for_all_that_is_fitted(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def told(x):
        read.add(1)
        return x

    cut = ml.cut
    monkeypatch.setattr(ml, "cut", lambda df: cut(df).select(told.asNondeterministic()("__n").alias("__n")))
    lines = [(i, " ".join(random.Random(i).choices("disk full error node pod slow retry".split(), k=9))) for i in range(40)]
    found = np.array([r["features"] for r in ml.log_features(spark.createDataFrame(lines, "i int, message string")).collect()])
    assert read.value == 40
    # Centred, along directions of decreasing spread that don't go together.
    shared = np.cov(found.T)
    assert np.allclose(found.mean(axis=0), 0) and np.allclose(shared, np.diag(np.diag(shared))) and (np.diff(np.diag(shared)) < 0).all()


def test_equal_vectors_are_scored_once(spark):
    rows = spark.createDataFrame([("k", i, [float(i % 3), 1.0]) for i in range(30)], "k string, i int, __x array<double>")
    models = spark.createDataFrame([("k", bytearray(ml._packed({"none": np.zeros(1)})))], "key string, model binary")
    found = ml._apply_models(rows, models, "k", lambda model, x: x[:, 0] + 10 * len(x), "score").collect()
    assert {r["i"]: r["score"] for r in found} == {i: i % 3 + 30 for i in range(30)}
