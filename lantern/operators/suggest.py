"""Suggestions for issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.graph_algo import degrees
from lantern.runtime import cut

#: Fixed: what is suggested for each type of issue and class of node.
ADVICE = {
    ("single_point_of_failure", "workload"): ("Increasing the number of replicas", "Adding pod anti-affinity rules to ensure pods are scheduled on different nodes", "Using a PodDisruptionBudget to ensure minimum availability during disruptions"),
    ("single_point_of_failure", "service"): ("Ensuring the service has multiple backend pods", "Using a multi-zone or multi-region deployment"),
    ("single_point_of_failure", "database"): ("Setting up database replication or clustering", "Implementing read replicas", "Setting up automatic failover"),
    ("single_point_of_failure", "other"): ("Deploying multiple instances across different availability zones", "Implementing a load balancer to distribute traffic", "Setting up automatic failover mechanisms"),
    ("circular_dependency", "other"): ("Consider introducing an asynchronous communication pattern", "Use an event-driven architecture with a message queue", "Extract shared functionality into a separate service", "Implement the Circuit Breaker pattern", "Use the Bulkhead pattern to isolate failures"),
    ("high_fanout", "other"): ("Introducing intermediary services or a facade pattern", "Using a message broker or event bus for communication", "Implementing service aggregation"),
    ("high_fanin", "other"): ("Introducing a load balancer or API gateway", "Implementing a service mesh", "Using a caching layer", "Scaling the service horizontally", "Implementing rate limiting and circuit breakers"),
    ("network_partition", "other"): ("No other partitions found to connect to", "Consider if this partition should be a separate system", "Or add a new service that can bridge the partitions"),
    ("database_single_instance", "aws"): ("For RDS: Enable Multi-AZ deployment", "For DynamoDB: Enable global tables", "For ElastiCache: Set up a replication group"),
    ("database_single_instance", "azure"): ("For Azure SQL: Enable geo-replication", "For Cosmos DB: Configure multi-region writes", "For Azure Cache for Redis: Use Premium tier with clustering"),
    ("database_single_instance", "google"): ("For Cloud SQL: Set up read replicas and high availability", "For Firestore: Use multi-region configuration", "For Memorystore: Enable high availability"),
    ("database_single_instance", "other"): ("Set up primary-replica replication", "Configure automatic failover", "Implement regular backups", "Consider using a managed database service with built-in replication"),
    ("missing_health_check", "pods"): ("Adding readiness and liveness probes to the Kubernetes manifest", "Implementing a /health or /status endpoint in your application", "Configuring appropriate timeouts and thresholds"),
    ("missing_health_check", "function"): ("Implementing a health check endpoint", "Setting up CloudWatch alarms (AWS) or equivalent monitoring", "Configuring appropriate retry policies"),
    ("missing_health_check", "other"): ("Implementing a health check endpoint in your application", "Setting up external monitoring to periodically check the endpoint", "Configuring alerts for when the health check fails"),
    ("missing_autoscaling", "pods"): ("Adding a Horizontal Pod Autoscaler (HPA) to the Kubernetes manifest", "Configuring resource requests and limits", "Setting appropriate min and max replicas", "Choosing appropriate metrics (CPU, memory, custom metrics)"),
    ("missing_autoscaling", "function"): ("Enabling provisioned concurrency (AWS Lambda)", "Configuring appropriate memory and timeout settings", "Setting up auto-scaling based on invocation metrics"),
    ("missing_autoscaling", "instance"): ("Setting up an auto-scaling group (AWS) or VM scale set (Azure)", "Configuring appropriate scaling policies based on CPU, memory, or custom metrics", "Setting appropriate min and max instance counts", "Configuring scale-in protection if needed"),
    ("missing_autoscaling", "other"): ("Implementing a scaling mechanism appropriate for the service type", "Setting up monitoring to track resource usage", "Configuring alerts for high resource usage", "Testing the scaling behavior under load"),
}
#: Fixed: the line above the advice of each type.
HEADS = {
    "single_point_of_failure": "Add redundancy for {} by:",
    "high_fanout": "Reduce the fanout of {} by:",
    "high_fanin": "Reduce the fanin of {} by:",
    "database_single_instance": "Add replication for the database {} by:",
    "missing_health_check": "Add health checks for {} by:",
    "missing_autoscaling": "Add autoscaling for {} by:",
}
#: Types that are resolved: the ones above, orphans, cycles and partitions.
RESOLVED = (*HEADS, "orphaned_service", "circular_dependency", "network_partition")


def kind_class(type_: Column, kind: Column, provider: Column) -> Column:
    """Which advice fits a node: by its lower-cased kind, and by the provider for databases."""
    low, of = F.lower(F.coalesce(kind, F.lit("unknown"))), F.lower(F.coalesce(provider, F.lit("")))
    cloud = F.lit("other")
    for name in ("google", "azure", "aws"):
        cloud = F.when(F.contains(low, F.lit(name)) | (of == name), name).otherwise(cloud)
    spof = F.when(low.isin("deployment", "statefulset", "daemonset"), "workload").when(low == "service", "service").when(F.contains(low, F.lit("database")) | low.isin("rds", "dynamodb", "cosmosdb"), "database").otherwise("other")
    health = F.when(low.isin("deployment", "statefulset", "daemonset", "pod"), "pods").when(F.contains(low, F.lit("function")), "function").otherwise("other")
    scaling = F.when(low.isin("deployment", "statefulset", "replicaset"), "pods").when(F.contains(low, F.lit("function")), "function").when(F.contains(low, F.lit("instance")) | F.contains(low, F.lit("vm")), "instance").otherwise("other")
    return (
        F.when(type_ == "single_point_of_failure", spof).when(type_ == "database_single_instance", cloud).when(type_ == "missing_health_check", health).when(type_ == "missing_autoscaling", scaling).otherwise("other")
    )


def advice_table(spark) -> DataFrame:
    rows = [(t, c, "\n".join(f"- {x}" for x in lines)) for (t, c), lines in ADVICE.items()]
    return spark.createDataFrame(rows, "type string, class string, advice string")


def resolve_issues(issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """A resolution for each issue whose type has a rule: status, suggestion, and the issue's new status.

    Without affected nodes (edges for cycles, two nodes for partitions) it fails; else a person is
    needed. Suggestions for orphans, groups of fan-out and the weakest edge of a cycle need the
    graph and come from the functions below.
    """
    known = nodes.select(F.col("node_id").alias("__n"), F.coalesce("name", "node_id").alias("__name"), F.coalesce("kind", F.lit("unknown")).alias("__kind"), "provider")
    rows = issues.where(F.col("type").isin(*RESOLVED)).withColumn("__first", F.get("affected_nodes", 0)).join(known, F.col("__first") == F.col("__n"), "left")
    rows = rows.withColumn("class", kind_class(F.col("type"), F.col("__kind"), F.col("provider")))
    advice = advice_table(issues.sparkSession)
    rows = rows.join(F.broadcast(advice.withColumnRenamed("type", "__t").withColumnRenamed("class", "__c")), (F.col("type") == F.col("__t")) & (F.col("class") == F.col("__c")), "left")
    lacking = F.when(F.col("type") == "circular_dependency", F.size("affected_edges") == 0).when(F.col("type") == "network_partition", F.size("affected_nodes") < 2).otherwise(F.size("affected_nodes") == 0)
    label = F.concat(F.coalesce("__name", "__first"), F.lit(" ("), F.coalesce("__kind", F.lit("unknown")), F.lit(")"))
    head = F.lit("Suggestion:")
    for t, text in HEADS.items():
        before, after = text.split("{}")
        head = F.when(F.col("type") == t, F.concat(F.lit(before), label, F.lit(after))).otherwise(head)
    failed = F.coalesce(lacking, F.lit(True))
    starts = (F.col("type") == "single_point_of_failure") & ~failed
    return rows.select(
        "type", "affected_nodes", F.col("class").alias("advice_class"),
        F.when(failed, "failed").otherwise("manual_intervention_required").alias("resolution_status"),
        F.when(~failed, F.concat_ws("\n", head, "advice")).alias("suggestion"),
        F.when(starts, "mitigating").otherwise(F.col("status")).alias("issue_status"),
        F.when(starts, "Adding redundancy").alias("mitigation_action"),
    )


def weakest_cycle_edge(edges: DataFrame, cycle_edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """``cycle, source, target, impact``: of each cycle's edges (``cycle, at, source, target``) the one on the fewest simple paths, the first on ties.

    All simple paths are counted, or those of up to ``max_length`` nodes: their number grows
    exponentially with the length, so graphs with many of them need the bound.
    """
    step = cut(edges.where("source <> target").select("source", "target").distinct())
    nxt = step.select(F.col("source").alias("at"), F.col("target").alias("next"))
    paths = step.select(F.array("source", "target").alias("nodes"), F.col("target").alias("at"))
    counts = None
    length = 1
    while (max_length is None or length < max_length) and not paths.isEmpty():
        length += 1
        pairs = paths.select(F.explode(F.zip_with(F.slice("nodes", F.lit(1), F.size("nodes") - 1), F.slice("nodes", F.lit(2), F.size("nodes") - 1), lambda a, b: F.struct(a.alias("source"), b.alias("target")))).alias("e"))
        one = pairs.groupBy("e.source", "e.target").agg(F.count("*").alias("n"))
        counts = one if counts is None else counts.union(one)
        if max_length is None or length < max_length:
            paths = cut(paths.join(nxt, "at").where("not array_contains(nodes, next)").select(F.concat("nodes", F.array("next")).alias("nodes"), F.col("next").alias("at")))
    if counts is None:
        return cycle_edges.select("cycle", "source", "target", F.lit(0).cast("long").alias("impact")).limit(0)
    impact = counts.groupBy("source", "target").agg(F.sum("n").alias("impact"))
    scored = cycle_edges.join(impact, ["source", "target"], "left").withColumn("impact", F.coalesce("impact", F.lit(0)))
    return scored.groupBy("cycle").agg(F.min_by(F.struct("source", "target", "impact"), F.struct("impact", "at")).alias("e")).select("cycle", "e.*")


def orphan_connections(orphans: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """``node_id, rank, other_id``: for each orphan the first ``most`` other nodes, as every kind is compatible with every other.

    Only the first ``most`` + 1 nodes in order can be any orphan's suggestions, so these alone are joined.
    """
    first = nodes.orderBy("seq").limit(most + 1).select(F.col("node_id").alias("other_id"), F.col("seq").alias("other_seq"))
    pairs = orphans.select("node_id").join(F.broadcast(first), F.col("node_id") != F.col("other_id"))
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy("other_seq"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most).select("node_id", "rank", "other_id")


def fanout_groups(nodes: DataFrame, edges: DataFrame, threshold: int = 10, named: int = 3) -> DataFrame:
    """``node_id, kind, n, text``: successors of nodes with high fan-out, by kind, of kinds with more than one; three are named."""
    out = edges.select("source", "target").distinct()
    high = out.groupBy("source").agg(F.count("*").alias("c")).where(F.col("c") >= threshold).select("source")
    kinds = nodes.select(F.col("node_id").alias("target"), F.coalesce("name", "node_id").alias("name"), F.coalesce("kind", F.lit("unknown")).alias("kind"), "seq")
    called = out.join(high, "source").join(kinds, "target").select(F.col("source").alias("node_id"), "kind", "seq", "name")
    counts = called.groupBy("node_id", "kind").agg(F.count("*").alias("n")).where("n > 1")
    place = F.row_number().over(Window.partitionBy("node_id", "kind").orderBy("seq", "name"))
    first = called.withColumn("place", place).where(F.col("place") <= named).groupBy("node_id", "kind").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("s"))
    rows = counts.join(first, ["node_id", "kind"])
    more = F.when(F.col("n") > named, F.concat(F.lit(" and "), (F.col("n") - named).cast("string"), F.lit(" more"))).otherwise("")
    text = F.concat(F.lit("Group "), F.col("n").cast("string"), F.lit(" "), "kind", F.lit(" services: "), F.array_join(F.transform("s", lambda x: x["name"]), ", "), more)
    return rows.select("node_id", "kind", "n", text.alias("text"))


def fanin_counts(nodes: DataFrame, edges: DataFrame, threshold: int = 10) -> DataFrame:
    """``node_id, incoming_connections`` of nodes with high fan-in."""
    return degrees(nodes, edges).where(F.col("in_degree") >= threshold).select("node_id", F.col("in_degree").alias("incoming_connections"))


def partition_links(partitions: DataFrame, most: int = 3) -> DataFrame:
    """``component_index, other_index``: the first ``most`` other partitions that each could be linked to."""
    first = partitions.orderBy("component_index").limit(most + 1).select(F.col("component_index").alias("other_index"))
    pairs = partitions.select("component_index").join(F.broadcast(first), F.col("component_index") != F.col("other_index"))
    rank = F.row_number().over(Window.partitionBy("component_index").orderBy("other_index"))
    return pairs.withColumn("r", rank).where(F.col("r") <= most).drop("r")
