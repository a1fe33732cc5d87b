"""Policies, attempts, learnt confidence and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.runtime import cut, dealt_by, lookup, sum_before

POLICY = """name string, action string, command string, service string, timeout_seconds int, max_retries int, cooldown_seconds int,
    issue_types array<string>, anomaly_patterns array<string>, services array<string>, min_severity int, min_score double, enabled boolean"""
#: Fixed: the default policies.
DEFAULT_POLICIES = (
    ("restart_pod", "restart_pod", "kubectl rollout restart deployment/${SERVICE} -n ${NAMESPACE}", None, 60, 3, 60, ["single_point_of_failure", "unreachable_service"], ["crash", "memory_error", "cpu_error"], None, 3, 0.7, True),
    ("scale_up", "scale_up", "kubectl scale deployment/${SERVICE} -n ${NAMESPACE} --replicas=${REPLICAS}", None, 60, 3, 60, ["high_fanin", "missing_autoscaling"], ["cpu_error"], None, 3, 0.7, True),
    ("restart_database", "restart_database", "kubectl rollout restart statefulset/${SERVICE} -n ${NAMESPACE}", None, 120, 2, 120, ["database_single_instance"], ["database_error"], None, 4, 0.8, True),
)
#: Fixed: a shipped rule table and a shipped table of action values.
RULES = (("cpu_spike", 3, "Scale Service"), ("memory_leak", 4, "Restart Service"), ("error_spike", 3, "Rollback Deployment"), ("disk_full", 4, "Clear Cache"))
Q_VALUES = {
    "cpu_spike_critical": {"Scale Service": 0.8, "Restart Service": 0.4, "Rollback Deployment": 0.2, "Drain Node": 0.1, "Clear Cache": 0.0},
    "memory_leak_critical": {"Scale Service": 0.3, "Restart Service": 0.9, "Rollback Deployment": 0.4, "Drain Node": 0.2, "Clear Cache": 0.5},
    "error_spike_critical": {"Scale Service": 0.2, "Restart Service": 0.5, "Rollback Deployment": 0.9, "Drain Node": 0.1, "Clear Cache": 0.0},
}


def policy_table(spark: SparkSession, policies=DEFAULT_POLICIES) -> DataFrame:
    return spark.createDataFrame(list(policies), POLICY)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_type string, min_severity int, action string")


def render(command: Column, **values: Column) -> Column:
    """A command template with its ``${NAME}`` places filled."""
    for name, value in values.items():
        command = F.replace(command, F.lit("${" + name + "}"), value.cast("string"))
    return command


_ANY = "*"


def _by_key(rows: DataFrame, key: str, policies: DataFrame, listed: str) -> DataFrame:
    """``rows`` with the enabled policies whose list ``p_<listed>`` holds the row's ``key``, or that have no list.

    Policies are exploded by what they list, one without a list under a key of its own that every row
    has too, so the join is one of equality at any number of policies.
    """
    p = policies.where("enabled").select(*[F.col(c).alias(f"p_{c}") for c in policies.columns])
    keyed = p.withColumn("__p", F.explode(F.when(F.col(f"p_{listed}").isNull(), F.array(F.struct(F.lit(True).alias("any"), F.lit(_ANY).alias("of")))).otherwise(F.transform(F.array_distinct(f"p_{listed}"), lambda x: F.struct(F.lit(False).alias("any"), x.alias("of"))))))
    asked = rows.withColumn("__r", F.explode(F.array(F.struct(F.lit(True).alias("any"), F.lit(_ANY).alias("of")), F.struct(F.lit(False).alias("any"), F.col(key).alias("of")))))
    return lookup(asked, keyed, "__r.any = __p.any and __r.of = __p.of", how="inner")


def match_issue_policies(issues: DataFrame, policies: DataFrame) -> DataFrame:
    """``issue_id, policy``: enabled policies whose types hold the issue's, severe enough, and, if both are set, for the service."""
    found = _by_key(issues, "type", policies, "issue_types").where(F.col("severity") >= F.col("p_min_severity"))
    scope = F.col("p_services").isNull() | F.col("p_service").isNull() | F.array_contains("p_services", F.col("p_service"))
    return found.where(scope).select("issue_id", F.col("p_name").alias("policy"))


def match_anomaly_policies(anomalies: DataFrame, policies: DataFrame) -> DataFrame:
    """``seq, policy``: as for issues, by pattern, severity and score, and the anomaly's service if the policy lists services."""
    found = _by_key(anomalies, "pattern_name", policies, "anomaly_patterns").where((F.col("severity") >= F.col("p_min_severity")) & (F.col("score") >= F.col("p_min_score")))
    scope = F.col("p_services").isNull() | F.col("service").isNull() | F.array_contains("p_services", F.col("service"))
    return found.where(scope).select("seq", F.col("p_name").alias("policy"))


def attempt_plan(attempts: DataFrame, max_retries: Column, cooldown: Column, keys: tuple[str, ...] = ("item", "policy")) -> DataFrame:
    """``retry_count, planned_status, due_at`` of attempts ``item, policy, ts, seq, failed``, per item and policy.

    The retry count is the failures before; at ``max_retries`` an attempt is skipped. A failure with
    retries left is due again ``cooldown`` seconds later. Nothing is run.
    """
    rows = sum_before(attempts, keys, ["ts", "seq"], F.col("failed").cast("int"), "retry_count")
    skipped = F.col("retry_count") >= max_retries
    status = F.when(skipped, "skipped").when(F.col("failed"), "failed").otherwise("succeeded")
    again = ~skipped & F.col("failed") & (F.col("retry_count") + 1 < max_retries)
    due = F.when(again, F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + cooldown * 1_000_000).cast("timestamp_ntz"))
    return rows.withColumn("planned_status", status).withColumn("due_at", due)


def get_results(results: DataFrame, count: int | None = None, since=None, status: str | None = None) -> DataFrame:
    """Results not before ``since``, with a status, the last ``count`` of them."""
    out = results if since is None else results.where(F.col("ts") >= F.lit(since))
    out = out if status is None else out.where(F.col("status") == status)
    return out if count is None else out.orderBy(F.desc("ts"), F.desc("seq")).limit(count)


def success_rate(results: DataFrame, since=None) -> DataFrame:
    """One row: the share of all results that succeeded, 0 without results."""
    rows = results if since is None else results.where(F.col("ts") >= F.lit(since))
    return rows.agg(F.coalesce(F.avg((F.col("status") == "succeeded").cast("double")), F.lit(0.0)).alias("success_rate"))


def rule_confidence(experiences: DataFrame, min_samples: int = 3) -> DataFrame:
    """``issue_type, action_id, n, confidence``: the share of successes of each pair seen often enough, derived anew from all experience."""
    grouped = experiences.groupBy("issue_type", "action_id").agg(F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("confidence"))
    return grouped.where(F.col("n") >= min_samples)


def available_actions(states: DataFrame, actions: DataFrame, target_type: Column | None = None) -> DataFrame:
    """``state_id`` with the actions whose target type is the first part of an affected service's id."""
    part = F.split_part("__s", F.lit("/"), F.lit(1)) if target_type is None else target_type
    kinds = states.select("state_id", "issue_type", F.explode("affected_services").alias("__s")).select("state_id", "issue_type", part.alias("__type"))
    # Most states have the same few types of targets, so no join deals them by type.
    kinds = dealt_by(kinds, "state_id", rows=states.count()).distinct()
    return lookup(kinds, actions, "__type = target_type", how="inner").drop("__type", "target_type").distinct()


def predict_action(available: DataFrame, confidence: DataFrame, least: float = 0.7) -> DataFrame:
    """``state_id, action_id, confidence``: the most confident action of ``least`` or more, the first in the library on ties, else the least risky with 0.5."""
    learnt = confidence.select(F.col("issue_type").alias("__type"), F.col("action_id").alias("__action"), F.col("confidence").alias("c"))
    known = lookup(dealt_by(available, "state_id", rows=available.count()), learnt, "issue_type = __type and action_id = __action")
    sure = F.coalesce(F.col("c") >= least, F.lit(False))
    best = F.max_by(F.struct("action_id", "c"), F.when(sure, F.struct("c", -F.col("lib_seq"))))
    safe = F.min_by("action_id", F.struct("risk_level", "lib_seq"))
    return known.groupBy("state_id").agg(best.alias("b"), safe.alias("s")).select("state_id", F.coalesce("b.action_id", "s").alias("action_id"), F.coalesce("b.c", F.lit(0.5)).alias("confidence"))


def recommend_action(predictions: DataFrame, available: DataFrame) -> DataFrame:
    """``state_id, action_id, confidence, learner``: the most confident prediction, of the first learner on ties, else the least risky action of learner ``default``.

    ``predictions`` are ``state_id, action_id, confidence, learner, learner_seq``. Both sides are sorted by state in as many tasks as
    ``available`` has rows for, which is counted first; so it should be cut.
    """
    rows = available.count()
    predictions, available = dealt_by(predictions, "state_id", rows=rows), dealt_by(available, "state_id", rows=rows)
    best = predictions.groupBy("state_id").agg(F.max_by(F.struct("action_id", "confidence", "learner"), F.struct("confidence", -F.col("learner_seq"))).alias("b"))
    safe = available.groupBy("state_id").agg(F.min_by("action_id", F.struct("risk_level", "lib_seq")).alias("s"))
    rows = safe.join(best, "state_id", "full")
    return rows.select("state_id", F.coalesce("b.action_id", "s").alias("action_id"), F.coalesce("b.confidence", F.lit(0.5)).alias("confidence"), F.coalesce("b.learner", F.lit("default")).alias("learner"))


def state_features(states: DataFrame) -> DataFrame:
    """``features``: metrics by name, severity / 5, affected services / 10, previous actions / 5."""
    metrics = F.transform(F.array_sort(F.map_entries("metrics")), lambda e: e["value"].cast("double"))
    rest = F.array(F.col("severity") / 5.0, F.size("affected_services") / 10.0, F.size("previous_actions") / 5.0)
    return states.withColumn("features", F.concat(metrics, rest))


def system_state_vector(issues: DataFrame, anomalies: DataFrame, metric_anomalies: DataFrame, root_causes: DataFrame) -> DataFrame:
    """One row ``s0`` to ``s9``: mean of all scores, then counts and means of each kind, capped at 1; the last is constant."""
    def one(rows: DataFrame, score: Column, p: str) -> DataFrame:
        return rows.agg(F.count("*").alias(f"{p}n"), F.coalesce(F.sum(score), F.lit(0.0)).alias(f"{p}s"))

    parts = [one(issues, F.col("severity") / 5, "i"), one(anomalies, F.col("score"), "a"), one(metric_anomalies, F.col("score"), "m"), one(root_causes, F.col("score"), "r")]
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(F.broadcast(p))  # one row each
    total = F.col("in") + F.col("an") + F.col("mn") + F.col("rn")
    mean = lambda p: F.coalesce(F.try_divide(F.col(f"{p}s"), F.col(f"{p}n")), F.lit(0.0))
    share = lambda p, most: F.least(F.lit(1.0), F.col(f"{p}n") / most)
    health = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("is") + F.col("as") + F.col("ms") + F.col("rs"), total), F.lit(0.0)))
    return row.select(
        health.alias("s0"), share("i", 10).alias("s1"), mean("i").alias("s2"), share("a", 10).alias("s3"), mean("a").alias("s4"),
        share("m", 10).alias("s5"), mean("m").alias("s6"), share("r", 5).alias("s7"), mean("r").alias("s8"), F.lit(0.5).alias("s9"),
    )


def transition_reward(before: Column, after: Column, high: float = 0.7) -> Column:
    """10 for each entry that is no longer high, less 2 for each that is, less 1, and 20 more if none is."""
    count = lambda v: F.size(F.filter(v, lambda x: x > high))
    return 10.0 * (count(before) - count(after)) - 2.0 * count(after) - 1.0 + F.when(count(after) == 0, 20.0).otherwise(0.0)


def anomalies_to_issues(flagged: DataFrame, order: list[str], z: str = "z_score", detector: str = "detector") -> DataFrame:
    """An issue for each flagged row: type ``<detector>_anomaly``, severity min(5, int(2 z)), 3 without a score, and a running id.

    The id needs an order of all rows: rows are numbered inside ranges of it, and the ranges' counts are summed.
    """
    rows = flagged.where("is_anomaly")
    score = F.col(z)
    severity = F.when(score.isNull(), 3).otherwise(F.least(F.lit(5), F.when(score > 100, 5).otherwise(F.floor(2 * F.least(score, F.lit(100.0))))).cast("int"))
    ranged = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order))))
    starts = ranged.groupBy("__part").agg(F.count("*").alias("__c"))
    starts = starts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    numbered = ranged.join(F.broadcast(starts), F.col("__part") == F.col("__p"))  # one row per partition
    return numbered.select(
        (F.col("__n") + F.col("__start")).cast("long").alias("issue_id"), F.concat(F.col(detector), F.lit("_anomaly")).alias("type"), severity.alias("severity"), *order, F.lit("detected").alias("status"),
    )


def incident_pipeline(issues: DataFrame, recommended: DataFrame, state_id: str = "issue_id") -> DataFrame:
    """Issues with the action recommended for them; ``mitigating`` where there is one."""
    r = recommended.select(F.col("state_id").alias("__id"), "action_id", "confidence", "learner")
    return issues.join(r, F.col(state_id) == F.col("__id"), "left").drop("__id").withColumn("status", F.when(F.col("action_id").isNotNull(), "mitigating").otherwise(F.col("status")))


def remediation_outcomes(issues: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``issue_status, reward, next_actions, next_health`` given what was observed (``issue_id, action_id, success``)."""
    rows = issues.join(outcomes, "issue_id")
    return rows.select(
        "issue_id", "action_id", F.when(F.col("success"), "mitigated").otherwise("failed").alias("issue_status"), F.when(F.col("success"), 1.0).otherwise(-0.5).alias("reward"),
        F.array_append("previous_actions", F.col("action_id")).alias("next_actions"), F.when(F.col("success"), "healthy").otherwise("degraded").alias("next_health"),
    )


def match_rule_table(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """``issue_id, action`` of the rules for the issue's type and severity."""
    return issues.join(rules, (F.col("type") == F.col("rule_type")) & (F.col("severity") >= rules["min_severity"])).select("issue_id", "action")


def q_policy(states: DataFrame, values=Q_VALUES, state: str = "state") -> DataFrame:
    """States with the action of the highest value, the first by name on ties; null for unknown states."""
    rows = [(s, a, float(v)) for s, own in values.items() for a, v in own.items()]
    table = states.sparkSession.createDataFrame(rows, "__state string, action string, value double")
    best = table.groupBy("__state").agg(F.min_by(F.struct("action", "value"), F.struct(-F.col("value"), F.col("action"))).alias("b"))
    return states.join(F.broadcast(best), F.col(state) == F.col("__state"), "left").select(*states.columns, F.col("b.action").alias("action"), F.col("b.value").alias("value"))
