"""Resources and references of infrastructure templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: categories of resource types, by category.
TERRAFORM_TYPES = {
    "compute": ("aws_instance", "azurerm_virtual_machine", "google_compute_instance"),
    "serverless": ("aws_lambda_function", "azurerm_function_app", "google_cloudfunctions_function"),
    "container": ("aws_ecs_service", "aws_ecs_task_definition", "azurerm_container_group", "google_cloud_run_service"),
    "kubernetes": ("aws_eks_cluster", "azurerm_kubernetes_cluster", "google_container_cluster", "kubernetes_deployment", "kubernetes_service", "kubernetes_ingress", "kubernetes_stateful_set", "kubernetes_config_map", "kubernetes_secret"),
    "api": ("aws_api_gateway_rest_api", "aws_api_gateway_resource", "aws_api_gateway_method", "aws_api_gateway_integration", "azurerm_api_management", "azurerm_api_management_api"),
    "loadbalancer": ("aws_lb", "aws_lb_listener", "aws_lb_target_group", "aws_lb_target_group_attachment", "azurerm_lb"),
    "database": ("aws_rds_cluster", "aws_rds_instance", "aws_dynamodb_table", "azurerm_sql_server", "azurerm_sql_database", "azurerm_cosmosdb_account", "google_sql_database_instance", "google_sql_database"),
    "cache": ("aws_elasticache_cluster", "azurerm_redis_cache"),
    "queue": ("aws_sqs_queue", "azurerm_servicebus_queue"),
    "topic": ("aws_sns_topic", "azurerm_servicebus_topic", "google_pubsub_topic"),
    "subscription": ("aws_sns_topic_subscription", "azurerm_servicebus_subscription", "google_pubsub_subscription"),
}
CLOUDFORMATION_TYPES = {
    "compute": ("AWS::EC2::Instance", "AWS::Batch::JobDefinition", "AWS::Batch::ComputeEnvironment"),
    "serverless": ("AWS::Lambda::Function",),
    "container": ("AWS::ECS::Service", "AWS::ECS::TaskDefinition", "AWS::ECS::Cluster"),
    "kubernetes": ("AWS::EKS::Cluster",),
    "api": ("AWS::ApiGateway::RestApi", "AWS::ApiGateway::Resource", "AWS::ApiGateway::Method", "AWS::ApiGateway::Stage", "AWS::ApiGatewayV2::Api", "AWS::ApiGatewayV2::Route", "AWS::ApiGatewayV2::Integration"),
    "loadbalancer": ("AWS::ElasticLoadBalancing::LoadBalancer", "AWS::ElasticLoadBalancingV2::LoadBalancer", "AWS::ElasticLoadBalancingV2::Listener", "AWS::ElasticLoadBalancingV2::TargetGroup"),
    "database": ("AWS::RDS::DBInstance", "AWS::RDS::DBCluster", "AWS::DynamoDB::Table", "AWS::Neptune::DBCluster", "AWS::Redshift::Cluster"),
    "cache": ("AWS::ElastiCache::CacheCluster", "AWS::ElastiCache::ReplicationGroup"),
    "queue": ("AWS::SQS::Queue",),
    "topic": ("AWS::SNS::Topic",),
    "subscription": ("AWS::SNS::Subscription",),
    "event": ("AWS::EventBridge::Rule", "AWS::Events::Rule"),
    "stream": ("AWS::Kinesis::Stream", "AWS::KinesisFirehose::DeliveryStream"),
    "storage": ("AWS::S3::Bucket", "AWS::EFS::FileSystem"),
    "network": ("AWS::EC2::VPC", "AWS::EC2::Subnet", "AWS::EC2::SecurityGroup", "AWS::EC2::RouteTable", "AWS::EC2::InternetGateway"),
    "security": ("AWS::IAM::Role", "AWS::IAM::Policy", "AWS::IAM::ManagedPolicy"),
}
#: Fixed: parameters that templates always have.
PSEUDO = ("AWS::Region", "AWS::AccountId", "AWS::NotificationARNs", "AWS::NoValue", "AWS::Partition", "AWS::StackId", "AWS::StackName", "AWS::URLSuffix")
BLOCK = r'(?s)\b{0}\s+"([^"]+)"\s+"([^"]+)"\s+\{{'


def category_table(spark: SparkSession, types: dict[str, tuple[str, ...]]) -> DataFrame:
    return spark.createDataFrame([(t, c) for c, own in types.items() for t in own], "resource_type string, category string")


def with_category(resources: DataFrame, types: dict[str, tuple[str, ...]] = TERRAFORM_TYPES) -> DataFrame:
    """Resources with the category of their type, ``other`` for unknown ones, and the provider before its first ``_`` or ``::``."""
    table = category_table(resources.sparkSession, types)
    provider = F.lower(F.get(F.split("resource_type", r"_|::"), 0))
    joined = resources.join(F.broadcast(table), "resource_type", "left")
    return joined.withColumn("category", F.coalesce("category", F.lit("other"))).withColumn("provider", provider)


def terraform_blocks(files: DataFrame, text: str = "text") -> DataFrame:
    """``file, block, resource_type, name, node_id, body`` of resource and data blocks.

    A body ends where its braces balance: the text after a block's opening is cut at the first place
    where one more is closed than opened, up to the next block at the latest.
    """
    def kind(word: str) -> DataFrame:
        pieces = F.split(text, BLOCK.format(word))
        heads = F.regexp_extract_all(text, F.lit(BLOCK.format(word)), F.lit(1))
        names = F.regexp_extract_all(text, F.lit(BLOCK.format(word)), F.lit(2))
        rows = files.select("file", F.posexplode(F.arrays_zip(heads.alias("t"), names.alias("n"), F.slice(pieces, F.lit(2), F.greatest(F.lit(0), F.size(pieces) - 1)).alias("b"))).alias("i", "x"))
        prefix = "data." if word == "data" else ""
        return rows.select("file", F.lit(word).alias("block"), "i", F.col("x.t").alias("resource_type"), F.col("x.n").alias("name"), F.concat(F.lit(prefix), "x.t", F.lit("."), "x.n").alias("node_id"), F.col("x.b").alias("rest"))

    rows = kind("resource").union(kind("data"))
    # Depth after each closing brace: pieces between '}' open as many as they hold '{'.
    parts = F.split("rest", r"\}")
    opened = F.transform(parts, lambda p: F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit(""))))
    depth = F.aggregate(
        opened, F.struct(F.lit(1).alias("d"), F.lit(0).alias("n")),
        lambda s, o: F.when(s["d"] <= 0, s).otherwise(F.struct((s["d"] + o - 1).alias("d"), (s["n"] + 1).alias("n"))),
    )["n"]
    return rows.withColumn("body", F.array_join(F.slice(parts, F.lit(1), depth), "}")).drop("rest", "i")


def terraform_references(blocks: DataFrame, compat: bool = False) -> DataFrame:
    """Edges ``source, target, type`` from blocks to the blocks that their bodies name, ``${a.b.c}`` or bare.

    Variables and calls are left out; the first part is a known type, or ``data`` before a type and a
    name. With ``compat`` there are none, as in a parser that cuts bodies at their first brace.
    """
    known = "|".join(t for own in TERRAFORM_TYPES.values() for t in own)
    found = F.array_distinct(F.concat(F.regexp_extract_all("body", F.lit(rf"(?<![\w.\"])((?:{known})\.[\w-]+)"), F.lit(1)), F.regexp_extract_all("body", F.lit(r"(?<![\w.\"])(data\.[\w-]+\.[\w-]+)"), F.lit(1))))
    rows = blocks.select(F.col("node_id").alias("source"), F.explode(found).alias("target")).where(F.lit(not compat))
    ids = blocks.select(F.col("node_id").alias("__id")).distinct()
    kind = F.when(F.col("target").startswith("data."), "data-reference").otherwise("reference")
    return rows.join(ids, F.col("target") == F.col("__id"), "left_semi").where("source <> target").select("source", "target", kind.alias("type")).distinct()


def cloudformation_resources(documents: DataFrame, stack: Column | None = None) -> DataFrame:
    """``seq, stack, logical_id, resource_type, node_id, properties`` of templates ``file, doc_seq, json``; the stack is the file's name."""
    name = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1) if stack is None else stack
    parsed = documents.select("seq", name.alias("stack"), F.from_json("json", "Resources map<string,string>")["Resources"].alias("r")).where("r is not null")
    rows = parsed.select("seq", "stack", F.explode("r").alias("logical_id", "body"))
    typed = rows.withColumns({"resource_type": F.get_json_object("body", "$.Type"), "properties": F.get_json_object("body", "$.Properties")}).where("resource_type is not null")
    return typed.select("seq", "stack", "logical_id", "resource_type", F.concat_ws("/", "stack", "logical_id").alias("node_id"), "properties")


def cloudformation_graph(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node per stack and resource, and ``contains`` edges from stacks to their resources."""
    stacks = resources.groupBy("stack").agg(F.min("seq").alias("seq")).select(F.col("stack").alias("node_id"), "seq", F.col("stack").alias("name"), F.lit("AWS::CloudFormation::Stack").alias("resource_type"))
    nodes = resources.select("node_id", "seq", F.col("logical_id").alias("name"), "resource_type").unionByName(stacks)
    edges = resources.select(F.col("stack").alias("source"), F.col("node_id").alias("target"), F.lit("contains").alias("type"))
    return with_category(nodes, CLOUDFORMATION_TYPES), edges


def cloudformation_references(resources: DataFrame) -> DataFrame:
    """Edges to the resources that properties name by ``Ref`` or by ``Fn::GetAtt`` with an attribute, over the serialised properties.

    Names are logical; the last stack with a name has it. Parameters that templates always have are skipped.
    """
    refs = F.transform(F.regexp_extract_all("properties", F.lit(r'\{"Ref":\s*"([^"]+)"\}'), F.lit(1)), lambda x: F.struct(x.alias("name"), F.lit("ref").alias("type")))
    pattern = F.lit(r'\{"Fn::GetAtt":\s*\["([^"]+)",\s*"([^"]+)"\]\}')
    atts = F.zip_with(F.regexp_extract_all("properties", pattern, F.lit(1)), F.regexp_extract_all("properties", pattern, F.lit(2)), lambda a, b: F.struct(a.alias("name"), F.lower(F.concat(F.lit("getatt."), b)).alias("type")))
    rows = resources.select(F.col("node_id").alias("source"), F.explode(F.array_distinct(F.concat(refs, atts))).alias("r")).where(~F.col("r.name").isin(*PSEUDO))
    owner = resources.groupBy(F.col("logical_id").alias("__l")).agg(F.max_by("node_id", F.struct("seq", "stack")).alias("target"))
    return rows.join(owner, F.col("r.name") == F.col("__l")).select("source", "target", F.col("r.type").alias("type")).distinct()
