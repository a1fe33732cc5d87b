"""Queries that read files; the files are written from the tables first, in the shared folder."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators import graph_build as G
from lantern.operators import infrastructure as I
from lantern.plans.base import query, relation
from lantern.plans.graphs import manifests
from lantern.runtime import cut, ensure_checkpoint_dir
from lantern.sources import readers as S
from lantern.sources import sinks


def staged(spark: SparkSession) -> str:
    """A new folder beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/staged-{uuid4().hex}"


#: Fixed: rows in a staged file or response at most, so that their number follows the table.
ROWS_PER_FILE = 1000


def _file(key):
    return F.floor(key / ROWS_PER_FILE).cast("long")


def _iso(c: str = "ts"):
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


@query("s01_read_logs", "select service, level, message, count(*) as n, cast(max(epoch(ts)) as bigint) as last from {logs} group by 1, 2, 3")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged(spark)
    relation(spark, sf_dir, "logs").select(_iso().alias("timestamp"), "level", "service", "message").write.json(path)
    return S.read_logs(spark, path).groupBy("service", "level", "message").agg(F.count("*").alias("n"), F.max(F.unix_timestamp("ts")).alias("last"))


@query("s02_stream_logs", "select service, level, count(*) as count from {logs} group by 1, 2")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, name = staged(spark), f"s02_{uuid4().hex}"
    relation(spark, sf_dir, "logs").select(_iso().alias("timestamp"), "level", "service", "message").write.json(path)
    counts = S.stream_logs(spark, path, files_per_trigger=2).groupBy("service", "level").count()
    run = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query("s05_read_metrics", "select service, metric_name, count(*) as n, round(sum(value), 4) as total from {metrics} group by 1, 2")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged(spark)
    relation(spark, sf_dir, "metrics").select(_iso().alias("timestamp"), "service", F.col("metric_name").alias("metric"), "value", F.lit("ms").alias("unit")).write.json(path)
    return S.read_metrics(spark, path).groupBy("service", "metric_name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _responses(spark: SparkSession, sf_dir: str, ranged: bool) -> DataFrame:
    m = relation(spark, sf_dir, "metrics")
    metric = F.create_map(F.lit("__name__"), "metric_name", F.lit("job"), F.lit("j"), F.lit("service"), "service", F.lit("region"), "region")
    pair = F.array(F.format_string("%.6f", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), F.col("value").cast("string"))
    if ranged:
        series = m.groupBy("metric_name", "service", "region", F.date_trunc("day", "ts"), _file(F.col("seq")).alias("g")).agg(F.collect_list(pair).alias("values")).select(F.struct(metric.alias("metric"), "values").alias("x"), F.col("g"))
    else:
        series = m.select(F.struct(metric.alias("metric"), pair.alias("value")).alias("x"), _file(F.col("seq")).alias("g"))
    grouped = series.groupBy("g").agg(F.collect_list("x").alias("result"))
    return grouped.select(F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.lit("vector").alias("resultType"), "result").alias("data"))).alias("body"))


FLAT = "select metric_name as name, service, region, count(*) as n, round(sum(value), 4) as total, cast(max(epoch_us(ts)) as bigint) as last from {metrics} group by 1, 2, 3"


def _flat(points: DataFrame) -> DataFrame:
    return points.groupBy("name", "service", F.element_at("dimensions", F.lit("region")).alias("region")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max(F.unix_micros("ts")).alias("last"))


@query("s06_flatten_instant", FLAT)
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(S.flatten_prom_instant(_responses(spark, sf_dir, False)))


@query("s07_flatten_range", FLAT)
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(S.flatten_prom_range(_responses(spark, sf_dir, True)))


@query("s08_graph_json", "select source, target, type from {geo_edges}")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged(spark)
    nodes = relation(spark, sf_dir, "geo_nodes").select("node_id", F.create_map(F.lit("kind"), "kind", F.lit("name"), "name").alias("attrs"))
    edges = relation(spark, sf_dir, "geo_edges").select("source", "target", F.create_map(F.lit("type"), "type").alias("attrs"))
    S.write_graph_json(nodes, edges, path)
    return S.read_graph_json(spark, path, lines=True)[1].select("source", "target", F.element_at("attrs", F.lit("type")).alias("type"))


@query("s09_read_manifests", "select 'Service' as kind, namespace, name from {svc} union all select 'Deployment', namespace, name from {dep}")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = manifests(spark, sf_dir).where("seq < 10000000000")
    files = docs.groupBy(F.concat(F.lit("file"), _file(F.col("seq")), F.lit(".yaml")).alias("file")).agg(F.concat_ws("\n---\n", F.array_sort(F.collect_list("json"))).alias("text"))
    loaded = S.load_documents(files)
    return G.parse_manifests(S.numbered(loaded.where("error is null"))).select("kind", "namespace", "name")


TF_KIND = "case p_partkey % 5 when 0 then 'aws_instance' when 1 then 'aws_lb' when 2 then 'google_sql_database' when 3 then 'azurerm_redis_cache' else 'own_thing' end"
TERRAFORM = f"""select p_partkey as k, 'f' || (p_partkey % 50) as file, {TF_KIND} as t, 'p' || p_partkey as n,
    case when p_partkey % 50 < p_partkey then ({TF_KIND.replace('p_partkey', '(p_partkey - 50)')}) || '.p' || (p_partkey - 50) end as ref from {{part}}"""


def terraform_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(TERRAFORM, part=relation(spark, sf_dir, "part")).withColumn("file", F.concat(F.lit("f"), _file(F.col("k"))))
    # A body with a nested block, a reference in it, a variable and a call.
    body = F.concat(F.lit(' {\n  size = var.size\n  tags = { a = "x" }\n'), F.when(F.col("ref").isNotNull(), F.concat(F.lit('  link = "'), F.lit("$"), F.lit("{"), F.col("ref"), F.lit('.id}"\n'))).otherwise(""), F.lit("  net { ami = data.aws_ami.base.id }\n  f = length(x)\n}\n"))
    block = F.concat(F.lit('resource "'), "t", F.lit('" "'), "n", F.lit('"'), body)
    grouped = rows.groupBy("file").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("k", block.alias("b")))), lambda x: x["b"])).alias("text"))
    return grouped.withColumn("text", F.concat(F.lit('data "aws_ami" "base" {\n  owner = "me"\n}\n'), "text")).withColumn("file", F.concat("file", F.lit(".tf")))


@query("s10_read_terraform", f"select t as resource_type, n as name, 'resource' as block, case when ref is null then 0 else 1 end as n_refs from ({TERRAFORM}) x")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = I.terraform_blocks(terraform_files(spark, sf_dir)).where("block = 'resource'")
    refs = F.size(F.regexp_extract_all("body", F.lit(r"\$\{([^}]*)\}"), F.lit(1)))
    return blocks.select("resource_type", "name", "block", refs.alias("n_refs"))


@query("g13_resource_category", f"select t || '.' || n as node_id, case t when 'aws_instance' then 'compute' when 'aws_lb' then 'loadbalancer' when 'google_sql_database' then 'database' when 'azurerm_redis_cache' then 'cache' else 'other' end as category, split_part(t, '_', 1) as provider from ({TERRAFORM}) x")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.with_category(I.terraform_blocks(terraform_files(spark, sf_dir)).where("block = 'resource'")).select("node_id", "category", "provider")


@query(
    "g14_terraform_references",
    f"select t || '.' || n as source, ref as target, 'reference' as type from ({TERRAFORM}) x where ref is not null and ref not like 'own_thing%' union all select t || '.' || n, 'data.aws_ami.base', 'data-reference' from ({TERRAFORM}) x",
)
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.terraform_references(I.terraform_blocks(terraform_files(spark, sf_dir)))


CFN = """select c_custkey as k, 'stack' || cast(floor(c_custkey / 1000) as bigint) as stack, 'R' || c_custkey as id, case c_custkey % 3 when 0 then 'AWS::EC2::Instance' when 1 then 'AWS::SQS::Queue' else 'AWS::Own::Thing' end as t,
    case when c_custkey >= 30 then 'R' || (c_custkey - 30) end as up, 'stack' || cast(floor((c_custkey - 30) / 1000) as bigint) as up_stack from {customer}"""


def cloudformation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(CFN, customer=relation(spark, sf_dir, "customer"))
    ref = F.create_map(F.lit("Ref"), F.coalesce("up", F.lit("AWS::Region")))
    att = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("Fn::GetAtt"), F.array(F.coalesce("up", F.lit("Nobody")), F.lit("Arn"))))
    body = F.struct(F.col("t").alias("Type"), F.struct(ref.alias("A"), F.array(F.struct(att.alias("B"))).alias("L")).alias("Properties"))
    grouped = rows.groupBy("stack").agg(F.map_from_entries(F.collect_list(F.struct("id", body.alias("b")))).alias("Resources"))
    text = F.to_json(F.struct(F.lit("2010-09-09").alias("AWSTemplateFormatVersion"), "Resources"))
    return grouped.select(F.concat(F.lit("/x/"), "stack", F.lit(".json")).alias("file"), text.alias("text"))


def cloudformation(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = S.load_documents(cloudformation_files(spark, sf_dir)).where("error is null")
    return I.cloudformation_resources(S.numbered(loaded))


@query("s11_read_cloudformation", f"select stack, id as logical_id, t as resource_type from ({CFN}) x")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloudformation(spark, sf_dir).select("stack", "logical_id", "resource_type")


@query("g15_cloudformation_graph", f"select stack as source, stack || '/' || id as target, 'contains' as type from ({CFN}) x")
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cloudformation_graph(cloudformation(spark, sf_dir))[1]


@query(
    "g15_cloudformation_nodes",
    f"select stack || '/' || id as node_id, case k % 3 when 0 then 'compute' when 1 then 'queue' else 'other' end as category from ({CFN}) x union all select distinct stack, 'other' from ({CFN}) x",
)
def g15_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cloudformation_graph(cloudformation(spark, sf_dir))[0].select("node_id", "category")


@query(
    "g16_cloudformation_references",
    f"select stack || '/' || id as source, up_stack || '/' || up as target, 'ref' as type from ({CFN}) x where up is not null union all select stack || '/' || id, up_stack || '/' || up, 'getatt.arn' from ({CFN}) x where up is not null and k % 2 = 0",
)
def g16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cloudformation_references(cloudformation(spark, sf_dir))


FILES = """select doc_id, case doc_id % 5 when 0 then '/a/' || doc_id || '.yaml' when 1 then '/a/' || doc_id || '.tf' when 2 then '/a/' || doc_id || '.json' when 3 then '/a/' || doc_id || '.yml' else '/a/' || doc_id || '.md' end as file,
    case when doc_id % 2 = 0 then 'apiVersion: v1 kind: Pod ' else '"Resources" ' end || text as text from {documents}"""


@query("s12_detect_source_format", "select doc_id, case when doc_id % 5 in (0, 3) and doc_id % 2 = 0 then 'kubernetes' when doc_id % 5 = 1 then 'terraform' when doc_id % 5 = 2 and doc_id % 2 = 1 then 'cloudformation' end as format from {documents}")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(FILES, documents=relation(spark, sf_dir, "documents"))
    return rows.select("doc_id", S.detect_source_format(F.col("file"), F.col("text")).alias("format"))


@query("s13_saved_model", "select issue_type, action_id, count(*) as n, round(avg(case when success then 1.0 else 0.0 end), 6) as confidence from {experiences} group by 1, 2 having count(*) >= 3")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.operators.remediation import rule_confidence

    path = staged(spark)
    sinks.save_model({"confidence": rule_confidence(relation(spark, sf_dir, "experiences"))}, path)
    return sinks.load_model(spark, path, "confidence")["confidence"].withColumn("confidence", F.round("confidence", 6))


@query("s13_saved_forest", "select metric_name, count(*) as n, 0 as n_changed from {metrics} group by metric_name")
def s13_saved_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.operators.ml import fit_forests, isolation_forest

    points, path = relation(spark, sf_dir, "metrics").select("seq", "metric_name", "value"), staged(spark)
    models = cut(fit_forests(points, "metric_name", F.array("value")))
    sinks.save_model({"forests": models}, path)
    again = sinks.load_model(spark, path, "forests")["forests"]
    score = lambda m, name: isolation_forest(points, "metric_name", F.array("value"), score_mode="reference", models=m).select("seq", "metric_name", F.col("iso_score").alias(name))
    both = score(models, "before").join(score(again, "after").drop("metric_name"), "seq")
    return both.groupBy("metric_name").agg(F.count("*").alias("n"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).cast("int").alias("n_changed"))


@query("s14_result_sink", "select service, count(*) as n from {logs} where level = 'ERROR' group by service")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged(spark)
    relation(spark, sf_dir, "logs").select(_iso().alias("timestamp"), "level", "service", "message").write.json(f"{path}/in")
    sinks.for_each_result(S.stream_logs(spark, f"{path}/in"), sinks.to_epochs(f"{path}/out", lambda batch: batch.where("level = 'ERROR'")), checkpoint=f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("service").agg(F.count("*").alias("n"))
