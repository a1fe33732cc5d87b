"""Scans of logs, metrics, responses of metric servers, graphs and infrastructure files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.runtime import in_order

LOG = "timestamp string, level string, service string, message string"
METRIC = "timestamp string, service string, metric string, value double, unit string"
INSTANT = "status string, data struct<resultType: string, result: array<struct<metric: map<string,string>, value: array<string>>>>"
RANGE = "status string, data struct<resultType: string, result: array<struct<metric: map<string,string>, values: array<array<string>>>>>"
#: Fixed: labels that aren't dimensions.
NOT_DIMENSIONS = ("__name__", "job", "instance")
MANIFEST_FILES = "*.{yaml,yml}"


def _logs(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_timestamp("timestamp").alias("ts"), "level", "service", "message", "file")


def _lines(spark: SparkSession, path: str, fmt: str, stream: bool, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    if per_trigger and stream:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if fmt == "json":
        return _logs(reader.schema(LOG).json(path).withColumn("file", F.col("_metadata.file_path")))
    if fmt == "text":
        lines = reader.text(path).withColumn("file", F.col("_metadata.file_path"))
        return lines.select(F.current_timestamp().alias("ts"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("service"), F.regexp_replace("value", r"\r$", "").alias("message"), "file")
    raise ValueError(f"unknown format {fmt!r}")


def read_logs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """``seq, ts, level, service, message, file`` of all lines; a text line has the time of the scan.

    ``seq`` grows along each file; it numbers lines, files in the order of Spark's partitions.
    """
    return _lines(spark, path, fmt, False).withColumn("seq", F.monotonically_increasing_id())


def stream_logs(spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """The lines of files as they come into a folder."""
    return _lines(spark, path, fmt, True, files_per_trigger)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``ts, service, metric_name, value, unit`` of a file of JSON lines."""
    rows = spark.read.schema(METRIC).json(path)
    return rows.select(F.to_timestamp("timestamp").alias("ts"), "service", F.col("metric").alias("metric_name"), "value", "unit")


def _points(rows: DataFrame, service: str | None) -> DataFrame:
    dims = F.map_filter("metric", lambda k, v: ~k.isin(*NOT_DIMENSIONS))
    named = F.element_at("metric", F.lit("service")) if service is None else F.lit(service)
    return rows.select(
        F.timestamp_seconds(F.get("v", 0).cast("double")).alias("ts"), F.element_at("metric", F.lit("__name__")).alias("name"), named.alias("service"), dims.alias("dimensions"), F.get("v", 1).cast("double").alias("value")
    )


def flatten_prom_instant(responses: DataFrame, body: str = "body", service: str | None = None) -> DataFrame:
    """``ts, name, service, dimensions, value`` of instant responses; a response that failed gives no rows."""
    parsed = responses.select(F.from_json(body, INSTANT).alias("r")).where("r.status = 'success'")
    return _points(parsed.select(F.explode("r.data.result").alias("x")).select("x.metric", F.col("x.value").alias("v")), service)


def flatten_prom_range(responses: DataFrame, body: str = "body", service: str | None = None) -> DataFrame:
    """As for instants, a row for each pair of a range response."""
    parsed = responses.select(F.from_json(body, RANGE).alias("r")).where("r.status = 'success'")
    series = parsed.select(F.explode("r.data.result").alias("x"))
    return _points(series.select("x.metric", F.explode("x.values").alias("v")), service)


def read_graph_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes ``node_id, attrs`` and edges ``source, target, attrs`` of documents with both lists; unknown keys are attributes.

    A document is a file, or with ``lines`` each line, as ``write_graph_json`` leaves them. Edges need
    both ends among the nodes of the documents.
    """
    shape = "nodes array<map<string,string>>, edges array<map<string,string>>"
    docs = spark.read.schema(shape).option("multiLine", not lines).json(path)
    rest = lambda m, *keys: F.map_filter(m, lambda k, v: ~k.isin(*keys))
    nodes = docs.select(F.explode("nodes").alias("n")).select(F.element_at("n", F.lit("id")).alias("node_id"), rest("n", "id").alias("attrs")).where("node_id is not null")
    edges = docs.select(F.explode("edges").alias("e")).select(F.element_at("e", F.lit("source")).alias("source"), F.element_at("e", F.lit("target")).alias("target"), rest("e", "source", "target").alias("attrs"))
    ids = nodes.select(F.col("node_id").alias("__id")).distinct()
    both = edges.join(ids, F.col("source") == F.col("__id"), "left_semi").join(ids, F.col("target") == F.col("__id"), "left_semi")
    return nodes, both


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write a graph of any size as lines, each a document with one node or one edge, for ``read_graph_json`` with ``lines``."""
    as_map = lambda first, attrs: F.map_concat(F.create_map(*first), F.coalesce(attrs, F.create_map().cast("map<string,string>")))
    n = nodes.select(F.array(as_map([F.lit("id"), F.col("node_id")], F.col("attrs"))).alias("nodes"))
    e = edges.select(F.array(as_map([F.lit("source"), F.col("source"), F.lit("target"), F.col("target")], F.col("attrs"))).alias("edges"))
    n.unionByName(e, allowMissingColumns=True).write.mode("overwrite").json(path)


def _yaml_documents(text: str):
    """The documents of a YAML text; short tags of templates read as their long forms."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def short(loader, suffix, node):
        if isinstance(node, yaml.ScalarNode):
            value = loader.construct_scalar(node)
            value = value.split(".", 1) if suffix == "GetAtt" else value
        elif isinstance(node, yaml.SequenceNode):
            value = loader.construct_sequence(node, deep=True)
        else:
            value = loader.construct_mapping(node, deep=True)
        return {"Ref" if suffix == "Ref" else f"Fn::{suffix}": value}

    Loader.add_multi_constructor("!", short)
    yield from yaml.load_all(text, Loader)  # noqa: S506  a safe loader with one more constructor


def _load(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in files:
        rows = []
        for file, text in zip(pdf["file"], pdf["text"], strict=True):
            try:
                if file.endswith((".json", ".template")) and text.lstrip().startswith("{"):
                    documents = [json.loads(text)]
                else:
                    documents = list(_yaml_documents(text))
                rows += [(file, i, json.dumps(d, default=str), None) for i, d in enumerate(documents) if isinstance(d, dict)]
            except Exception as error:  # noqa: BLE001  a bad file is a row, not a failed job
                rows.append((file, 0, None, f"{type(error).__name__}: {error}"[:500]))
        yield pd.DataFrame(rows, columns=["file", "doc_seq", "json", "error"])


def load_documents(files: DataFrame) -> DataFrame:
    """``file, doc_seq, json, error`` of YAML or JSON texts ``file, text``: a row per document; a file that can't be read gives one with its error."""
    return files.mapInPandas(_load, "file string, doc_seq int, json string, error string")


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``file, text`` of whole files under a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))


def numbered(documents: DataFrame) -> DataFrame:
    """Documents with ``seq``: an order by file and place that is the same in every run.

    Files are sorted in ranges and numbered range by range; no task gets all names.
    """
    files = in_order(documents.select("file").distinct(), "file", name="__f")
    return documents.join(files.withColumnRenamed("file", "__file"), F.col("file") == F.col("__file")).withColumn("seq", F.col("__f") * (1 << 20) + F.col("doc_seq")).drop("__f", "__file")


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The documents of all YAML files under a folder, and the files that can't be read with their errors; other files aren't opened."""
    loaded = load_documents(read_files(spark, path, MANIFEST_FILES))
    return numbered(loaded.where("error is null")), loaded.where("error is not null").select("file", "error")


def detect_source_format(file: Column, text: Column) -> Column:
    """``kubernetes``, ``terraform`` or ``cloudformation`` by a file's name and content, else null."""
    has = lambda x: F.contains(text, F.lit(x))
    return (
        F.when(file.rlike(r"\.ya?ml$") & has("apiVersion:") & has("kind:"), "kubernetes")
        .when(file.endswith(".tf"), "terraform")
        .when(file.rlike(r"\.(json|template)$") & (has('"AWSTemplateFormatVersion"') | has('"Resources"')), "cloudformation")
    )
