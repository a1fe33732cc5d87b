"""Staged files hold a bounded number of rows, so that their number follows the table."""

import json

import pytest
from pyspark.sql import functions as F

import lantern.plans.base as base
from lantern.plans import files


@pytest.fixture(scope="module")
def larger(spark, small, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("larger"))
    for t in base.TABLES:
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    events = spark.read.parquet(f"{small}/events.parquet")
    parts = spark.read.parquet(f"{small}/part.parquet")
    # Two hundred times the events and five hundred times the parts, with keys that go on.
    many = lambda df, key, n: df.crossJoin(spark.range(n).withColumnRenamed("id", "__i")).withColumn(key, F.col(key) + F.col("__i") * 1_000_000).drop("__i")
    many(events, "event_id", 200).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    many(parts, "p_partkey", 500).write.mode("overwrite").parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("ranged", [False, True])
def test_responses_stay_bounded(spark, larger, ranged):
    sizes = []
    for r in files._responses(spark, larger, ranged).collect():
        result = json.loads(r["body"])["data"]["result"]
        sizes.append(sum(len(x["values"]) if ranged else 1 for x in result))
    assert sum(sizes) == spark.read.parquet(f"{larger}/events.parquet").count() and max(sizes) <= files.ROWS_PER_FILE


def test_terraform_files_stay_bounded(spark, larger):
    sizes = [r["text"].count("resource ") for r in files.terraform_files(spark, larger).collect()]
    assert sum(sizes) == spark.read.parquet(f"{larger}/part.parquet").count() and max(sizes) <= files.ROWS_PER_FILE
