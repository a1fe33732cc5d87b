"""Likely root causes from graph, issues and anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.graph_algo import degrees, reachability
from lantern.runtime import cut

FEATURES = (
    "health", "n_issues", "mean_severity", "n_anomalies", "mean_anomaly", "n_metric_anomalies", "mean_metric", "in_degree", "out_degree", "degree_ratio", "total_degree",
)


def newest_per_node(rows: DataFrame, most: int = 100, ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """The newest ``most`` rows of each node; of one instant those of the greatest ``tie``."""
    n = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc(ts), *[F.desc(c) for c in tie]))
    return rows.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def problem_nodes(anomalies: DataFrame, issues: DataFrame, metric_anomalies: DataFrame) -> DataFrame:
    """``node_id`` of nodes with any anomaly or issue."""
    return anomalies.select("node_id").union(issues.select("node_id")).union(metric_anomalies.select("node_id")).distinct()


def problem_subgraph(problems: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Problem nodes with their direct neighbours, and the edges among them."""
    pairs = edges.select("source", "target").distinct()
    out = pairs.join(problems.withColumnRenamed("node_id", "source"), "source", "left_semi").select(F.col("target").alias("node_id"))
    into = pairs.join(problems.withColumnRenamed("node_id", "target"), "target", "left_semi").select(F.col("source").alias("node_id"))
    nodes = problems.union(out).union(into).distinct()
    inside = pairs.join(nodes.withColumnRenamed("node_id", "source"), "source", "left_semi").join(nodes.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return nodes, inside


def _means(rows: DataFrame, value, name: str, count: str) -> DataFrame:
    return rows.groupBy("node_id").agg(F.avg(value).alias(name), F.count("*").alias(count))


def evidence(nodes: DataFrame, anomalies: DataFrame, issues: DataFrame, metric_anomalies: DataFrame) -> DataFrame:
    """Nodes with the counts and means of their log anomalies, issues and metric anomalies; 0 where there are none."""
    a = _means(anomalies, F.col("score") * F.col("severity") / 5, "mean_anomaly", "n_anomalies")
    i = _means(issues, F.col("severity") / 5, "mean_severity", "n_issues")
    m = _means(metric_anomalies, F.col("score"), "mean_metric", "n_metric_anomalies")
    out = nodes.join(a, "node_id", "left").join(i, "node_id", "left").join(m, "node_id", "left")
    return out.fillna(0, ["mean_anomaly", "n_anomalies", "mean_severity", "n_issues", "mean_metric", "n_metric_anomalies"])


def graph_scores(nodes: DataFrame, edges: DataFrame, anomalies: DataFrame, issues: DataFrame, metric_anomalies: DataFrame, direction: str = "forward") -> DataFrame:
    """``node_id, score`` of the nodes around problems: health, the three means, and the share of problem nodes that are reached.

    ``nodes`` have ``node_id`` and optionally ``health`` in [0, 1], 1 by default. Edges run from
    callers to what they call, so callers of problems score; ``reverse`` lets the called score.
    """
    problems = problem_nodes(anomalies, issues, metric_anomalies)
    inside_nodes, inside = problem_subgraph(problems, edges)
    if direction == "reverse":
        inside = inside.select(F.col("target").alias("source"), F.col("source").alias("target"))
    # From all problems at once, against the edges: who reaches them.
    against = inside.select(F.col("target").alias("source"), F.col("source").alias("target"))
    reached = reachability(against, problems).where("root <> node_id").groupBy("node_id").agg(F.countDistinct("root").alias("n_reached"))
    total = problems.agg(F.count("*").alias("n_problems"))
    health = F.coalesce("health", F.lit(1.0)) if "health" in nodes.columns else F.lit(1.0)
    known = inside_nodes.join(nodes.withColumn("health", health).select("node_id", "health"), "node_id")
    rows = evidence(known, anomalies, issues, metric_anomalies).join(reached, "node_id", "left").crossJoin(F.broadcast(total))
    topology = F.coalesce("n_reached", F.lit(0)) / F.col("n_problems") * 0.1
    score = (1 - F.col("health")) * 0.3 + F.col("mean_anomaly") * 0.2 + F.col("mean_severity") * 0.2 + F.col("mean_metric") * 0.2 + topology
    return rows.select("node_id", F.least(F.lit(1.0), score).alias("score")).where("score > 0")


def propagation_paths(edges: DataFrame, problems: DataFrame) -> DataFrame:
    """``node_id, path``: shortest paths from each node to all problems that it reaches, one after the other, every node once.

    All paths are walked at once, a step a round, and only where a walk is and the first place of each
    node met so far are kept. As a problem that a node reaches is on its path, neither has more rows than
    the paths that are given have nodes.
    """
    reached = cut(reachability(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), problems).where("root <> node_id"))
    parents = reached.select(F.col("root").alias("__r"), F.col("node_id").alias("__n"), F.col("parent").alias("__p"))
    walks, k = reached.select("node_id", "root", F.col("node_id").alias("at")), 0
    first = None
    while True:
        met = walks.groupBy("node_id", "at").agg(F.min(F.struct("root", F.lit(k).alias("k"))).alias("place"))
        first = cut(met if first is None else first.union(met).groupBy("node_id", "at").agg(F.min("place").alias("place")))
        walks = walks.where("at <> root")
        walks = cut(walks.join(parents, F.expr("root = __r and at = __n")).select("node_id", "root", F.col("__p").alias("at")))
        if walks.isEmpty():
            break
        k += 1
    gathered = first.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("place", "at"))).alias("p"))
    return gathered.select("node_id", F.transform("p", lambda x: x["at"]).alias("path"))


def node_features(nodes: DataFrame, edges: DataFrame, anomalies: DataFrame, issues: DataFrame, metric_anomalies: DataFrame) -> DataFrame:
    """The eleven features of every node; without a way out the ratio is the in-degree."""
    health = F.coalesce("health", F.lit(1.0)) if "health" in nodes.columns else F.lit(1.0)
    rows = evidence(nodes.select("node_id", health.alias("health")), anomalies, issues, metric_anomalies).join(degrees(nodes, edges), "node_id")
    ratio = F.when(F.col("out_degree") > 0, F.col("in_degree") / F.col("out_degree")).otherwise(F.col("in_degree").cast("double"))
    return rows.withColumn("degree_ratio", ratio).withColumn("total_degree", F.col("in_degree") + F.col("out_degree")).select("node_id", *[F.col(c).cast("double").alias(c) for c in FEATURES])


def train_root_cause_model(features: DataFrame, label: str = "is_root_cause", seed: int = 42):
    """A forest of 100 trees of depth 10 on four fifths of the rows, and its precision, recall and F1 on the rest; without root causes there, no figures."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    rows = cut(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features.withColumn("label", F.col(label).cast("double"))))
    train, test = rows.randomSplit([0.8, 0.2], seed)
    # A level starts from the nodes that rows have reached, instead of walking each tree from its root again.
    model = RandomForestClassifier(numTrees=100, maxDepth=10, seed=seed, cacheNodeIds=True).fit(train)
    scored = model.transform(test)
    found = {}
    if not scored.where("label = 1").isEmpty():
        for name in ("precisionByLabel", "recallByLabel", "fMeasureByLabel"):
            found[name] = MulticlassClassificationEvaluator(metricName=name, metricLabel=1.0).evaluate(scored)
    return model, found


def ml_scores(model, features: DataFrame, least: float = 0.1) -> DataFrame:
    """``node_id, score``: the model's probability of a root cause, above ``least``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features)
    p = F.get(vector_to_array("probability"), 1)
    return model.transform(rows).select("node_id", F.coalesce(p, F.lit(0.0)).alias("score")).where(F.col("score") > least)


def combine_scores(graph: DataFrame, ml: DataFrame) -> DataFrame:
    """0.4 of the graph's and 0.6 of the model's score where the model has one, else the graph's; one side alone if the other is empty."""
    g, m = graph.select("node_id", F.col("score").alias("g")), ml.select("node_id", F.col("score").alias("m"))
    has_graph, has_ml = g.agg((F.count("*") > 0).alias("has_g")), m.agg((F.count("*") > 0).alias("has_m"))
    rows = g.join(m, "node_id", "full").crossJoin(F.broadcast(has_graph)).crossJoin(F.broadcast(has_ml))
    a, b = F.coalesce("g", F.lit(0.0)), F.coalesce("m", F.lit(0.0))
    score = F.when(~F.col("has_g"), b).when(~F.col("has_m"), a).when(b > 0, 0.4 * a + 0.6 * b).otherwise(a)
    return rows.select("node_id", score.alias("score"))
