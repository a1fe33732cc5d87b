"""Queries of suggestions, root causes, policies and incidents."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators import checks as D
from lantern.operators import remediation as E
from lantern.operators import rootcause as C
from lantern.operators import suggest as R
from lantern.plans.base import query, relation
from lantern.plans.graphs import ALL_SQL, CYCLES, TEAM_CYCLES, geo, geo_once
from lantern.runtime import cut, written


def _advice_sql() -> str:
    rows = ", ".join("('{}', '{}', '{}')".format(t, c, "\\n".join(f"- {x}" for x in lines).replace("'", "''")) for (t, c), lines in R.ADVICE.items())
    return f"(values {rows}) adv(t, c, advice)".replace("{", "{{").replace("}", "}}")


KIND = """case type when 'single_point_of_failure' then case when k in ('deployment', 'statefulset', 'daemonset') then 'workload' when k = 'service' then 'service' when contains(k, 'database') or k in ('rds', 'dynamodb', 'cosmosdb') then 'database' else 'other' end
    when 'database_single_instance' then case when contains(k, 'aws') or p = 'aws' then 'aws' when contains(k, 'azure') or p = 'azure' then 'azure' when contains(k, 'google') or p = 'google' then 'google' else 'other' end
    when 'missing_health_check' then case when k in ('deployment', 'statefulset', 'daemonset', 'pod') then 'pods' when contains(k, 'function') then 'function' else 'other' end
    when 'missing_autoscaling' then case when k in ('deployment', 'statefulset', 'replicaset') then 'pods' when contains(k, 'function') then 'function' when contains(k, 'instance') or contains(k, 'vm') then 'instance' else 'other' end
    else 'other' end"""
RESOLVED = f"""i as ({ALL_SQL.replace('with recursive', 'with recursive')}), j as (select i.*, lower(n.kind) as k, n.provider as p, n.name as nm, n.kind as kd from i join {{geo_nodes}} n on n.node_id = split_part(i.nodes, '|', 1)),
    q as (select *, {KIND} as class from j)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = geo_once(spark, sf_dir)
    return R.resolve_issues(D.detect_issues(nodes, edges, nodes_written=True), nodes)


@query(
    "r01_resolve_issues",
    f"""with {RESOLVED} select type, nodes, class as advice_class, case when type = 'network_partition' and not contains(nodes, '|') then 'failed' else 'manual_intervention_required' end as resolution_status,
        case when type = 'single_point_of_failure' then 'mitigating' else 'detected' end as issue_status, case when type = 'single_point_of_failure' then 'Adding redundancy' end as mitigation_action from q""",
)
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("type", F.array_join("affected_nodes", "|").alias("nodes"), "advice_class", "resolution_status", "issue_status", "mitigation_action")


CHECKS = {
    "single_point_of_failure": D.single_points_of_failure,
    "high_fanin": D.high_fanin,
    "database_single_instance": lambda nodes, edges: D.database_single_instance(nodes),
    "missing_health_check": lambda nodes, edges: D.missing_health_checks(nodes),
    "missing_autoscaling": lambda nodes, edges: D.missing_autoscaling(nodes),
}


def _advice(name: str, type_: str, head: str) -> None:
    before, after = head.split("{}")
    sql = f"""with {RESOLVED} select nodes, '{before}' || nm || ' (' || kd || '){after}' || chr(10) || replace(advice, '\\n', chr(10)) as suggestion from q join {_advice_sql()} on adv.t = type and adv.c = class where type = '{type_}'"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes, edges = (geo_once if type_ == "single_point_of_failure" else geo)(spark, sf_dir)
        return R.resolve_issues(CHECKS[type_](nodes, edges), nodes).select(F.array_join("affected_nodes", "|").alias("nodes"), "suggestion")

    query(name, sql)(run)


for _name, _type in (("r02_spof_advice", "single_point_of_failure"), ("r06_fanin_advice", "high_fanin"), ("r08_replication_advice", "database_single_instance"), ("r09_health_advice", "missing_health_check"), ("r10_autoscaling_advice", "missing_autoscaling")):
    _advice(_name, _type, R.HEADS[_type])


@query(
    "r03_weakest_cycle_edge",
    f"""with recursive {CYCLES}, cyc as (select array_to_string(nodes, '|') as cycle, nodes from p join t on t.source = p.at and t.target = nodes[1] where len(nodes) <= 4),
        e as (select cycle, i as pos, nodes[i] as source, nodes[case when i = len(nodes) then 1 else i + 1 end] as target from (select *, unnest(generate_series(1, len(nodes))) as i from cyc) x),
        sp as (select [source, target] as nodes, target as at from t union all select list_append(nodes, t.target), t.target from sp join t on t.source = sp.at where len(nodes) < 4 and not list_contains(nodes, t.target)),
        im as (select nodes[i] as source, nodes[i + 1] as target, count(*) as impact from (select nodes, unnest(generate_series(1, len(nodes) - 1)) as i from sp) z group by 1, 2)
        select cycle, source, target, cast(impact as bigint) as impact from (select e.*, im.impact, row_number() over (partition by cycle order by impact, pos) as r from e join im using (source, target)) y where r = 1""",
)
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = relation(spark, sf_dir, "trade_edges")
    issues = D.circular_dependencies(edges, 4)[0].select(F.array_join("affected_nodes", "|").alias("cycle"), F.posexplode("affected_edges").alias("at", "e")).select("cycle", "at", "e.source", "e.target")
    return R.weakest_cycle_edge(edges, issues, 4).withColumn("impact", F.col("impact").cast("long"))


@query(
    "r03_team_weakest_edges",
    f"""with recursive {TEAM_CYCLES}, cyc as (select array_to_string(nodes, '|') as cycle, nodes from p join t on t.source = p.at and t.target = nodes[1]),
        e as (select cycle, i as pos, nodes[i] as source, nodes[case when i = len(nodes) then 1 else i + 1 end] as target from (select *, unnest(generate_series(1, len(nodes))) as i from cyc) x),
        sp as (select [source, target] as nodes, target as at from t union all select list_append(nodes, t.target), t.target from sp join t on t.source = sp.at where not list_contains(nodes, t.target)),
        im as (select nodes[i] as source, nodes[i + 1] as target, count(*) as impact from (select nodes, unnest(generate_series(1, len(nodes) - 1)) as i from sp) z group by 1, 2)
        select cycle, source, target, cast(impact as bigint) as impact from (select e.*, im.impact, row_number() over (partition by cycle order by impact, pos) as r from e join im using (source, target)) y where r = 1""",
)
def r03_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = relation(spark, sf_dir, "team_edges")
    issues = D.all_circular_dependencies(edges).select(F.array_join("affected_nodes", "|").alias("cycle"), F.posexplode("affected_edges").alias("at", "e")).select("cycle", "at", "e.source", "e.target")
    return R.weakest_cycle_edge(edges, issues).withColumn("impact", F.col("impact").cast("long"))


@query(
    "r04_orphan_connections",
    """with o as (select node_id from {geo_nodes} where node_id not in (select source from {geo_edges}) and node_id not in (select target from {geo_edges}))
       select * from (select o.node_id, cast(row_number() over (partition by o.node_id order by n.seq) as integer) as rank, n.node_id as other_id from o join (select * from {geo_nodes} order by seq limit 6) n on n.node_id <> o.node_id) x where rank <= 5""",
)
def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = geo(spark, sf_dir)
    orphans = D.orphaned_services(nodes, edges).select(F.col("affected_nodes")[0].alias("node_id"))
    return R.orphan_connections(orphans, nodes)


FANOUT = """with o as (select distinct source, target from {trade_edges}), h as (select source from o group by source having count(*) >= 3),
    g as (select o.source, n.kind, count(*) as n, list(n.name order by n.seq, n.name) as names from o join h using (source) join {trade_nodes} n on n.node_id = o.target group by 1, 2 having count(*) > 1)
    select source as node_id, kind, n, 'Group ' || n || ' ' || kind || ' services: ' || array_to_string(names[1:3], ', ') || case when n > 3 then ' and ' || (n - 3) || ' more' else '' end as text from g"""


@query("r05_fanout_groups", FANOUT)
def r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fanout_groups(relation(spark, sf_dir, "trade_nodes"), relation(spark, sf_dir, "trade_edges"), 3)


@query("r05_fanout_groups_orders", FANOUT.replace("trade_nodes", "geo_nodes").replace("trade_edges", "order_edges").replace("count(*) >= 3", "count(*) >= 10"))
def r05_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fanout_groups(relation(spark, sf_dir, "geo_nodes"), relation(spark, sf_dir, "order_edges"), 10)


@query("r06_fanin_counts", "select target as node_id, cast(count(*) as bigint) as incoming_connections from (select distinct source, target from {geo_edges}) e group by target having count(*) >= 10")
def r06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fanin_counts(*geo(spark, sf_dir))


@query(
    "r07_partition_links",
    f"""with i as ({ALL_SQL}), p as (select cast(row_number() over (order by cast(regexp_extract(description, 'Component ([0-9]+)', 1) as bigint)) - 1 as bigint) as c from i where type = 'network_partition')
        select c as component_index, o as other_index from (select p.c, q.c as o, row_number() over (partition by p.c order by q.c) as r from p join (select * from p order by c limit 4) q on p.c <> q.c) x where r <= 3""",
)
def r07(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = D.network_partitions(*geo(spark, sf_dir)).select(F.col("metadata")["component_index"].cast("long").alias("component_index"))
    return R.partition_links(parts)


# Problems sit on the nations of the trade graph, each kind on nodes of its own; every event belongs to one of them.
PROBLEMS = """nd as (select node_id, seq, 1 - (seq % 10) / 20.0 as health from {trade_nodes}),
    an as (select n.node_id, a.score, a.severity, a.ts, a.seq from {anomalies} a join {trade_nodes} n on n.seq = a.seq % 9 * 3),
    iss as (select n.node_id, i.severity, i.detected_at as ts from {issues} i join {trade_nodes} n on n.seq = i.issue_id % 6 * 4 + 1),
    mt as (select n.node_id, round(m.value / 500, 6) as score, m.ts from {metrics} m join {trade_nodes} n on n.seq = m.seq % 5 * 5 + 2)"""
TABLES = ("trade_nodes", "trade_edges", "anomalies", "issues", "metrics")


def evidence(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    r = {x: relation(spark, sf_dir, x) for x in TABLES}
    text = f"with {PROBLEMS} select * from "
    sub = {k: r[k] for k in ("trade_nodes", "anomalies", "issues", "metrics")}
    return {n: spark.sql(text + n, **sub) for n in ("nd", "an", "iss", "mt")} | {"edges": r["trade_edges"]}


SQL_C = PROBLEMS + """, pr as (select node_id from an union select node_id from iss union select node_id from mt), ed as (select distinct source, target from {trade_edges}),
    sg as (select node_id from pr union select target from ed where source in (select node_id from pr) union select source from ed where target in (select node_id from pr)),
    ie as (select * from ed where source in (select node_id from sg) and target in (select node_id from sg))"""
SQL_C4 = SQL_C + ", hop as (select source as n0, target as m from ie union select h.n0, e.target from hop h join ie e on e.source = h.m), rc as (select n0 as node_id, count(distinct m) as n from hop where m in (select node_id from pr) and m <> n0 group by n0)"
SQL_C5 = SQL_C4 + """, sc as (select sg.node_id, least(1.0, (1 - nd.health) * 0.3 + coalesce(a.s, 0) * 0.2 + coalesce(i.s, 0) * 0.2 + coalesce(m.s, 0) * 0.2 + coalesce(rc.n, 0) / (select count(*) from pr) * 0.1) as score
    from sg join nd using (node_id) left join (select node_id, avg(score * severity / 5) as s from an group by 1) a using (node_id) left join (select node_id, avg(severity / 5) as s from iss group by 1) i using (node_id)
    left join (select node_id, avg(score) as s from mt group by 1) m using (node_id) left join rc using (node_id))"""


@query("c01_problem_nodes", f"with {SQL_C} select node_id from pr")
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    return C.problem_nodes(e["an"], e["iss"], e["mt"])


@query("c01_newest_per_node", f"with {PROBLEMS} select node_id, seq from (select *, row_number() over (partition by node_id order by ts desc, seq desc) as i from an) x where i <= 100")
def c01_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.newest_per_node(evidence(spark, sf_dir)["an"], tie=["seq"]).select("node_id", "seq")


@query("c02_problem_subgraph", f"with {SQL_C} select source, target from ie")
def c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    return C.problem_subgraph(C.problem_nodes(e["an"], e["iss"], e["mt"]), e["edges"])[1]


@query(
    "c03_evidence",
    f"with {PROBLEMS} select nd.node_id, coalesce(a.n, 0) as n_anomalies, round(coalesce(a.s, 0), 6) as mean_anomaly, coalesce(i.n, 0) as n_issues, round(coalesce(i.s, 0), 6) as mean_severity, coalesce(m.n, 0) as n_metric_anomalies, round(coalesce(m.s, 0), 6) as mean_metric from nd left join (select node_id, count(*) as n, avg(score * severity / 5) as s from an group by 1) a using (node_id) left join (select node_id, count(*) as n, avg(severity / 5) as s from iss group by 1) i using (node_id) left join (select node_id, count(*) as n, avg(score) as s from mt group by 1) m using (node_id)",
)
def c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    means = [F.round(c, 6).alias(c) for c in ("mean_anomaly", "mean_severity", "mean_metric")]
    return C.evidence(e["nd"].select("node_id"), e["an"], e["iss"], e["mt"]).select("node_id", "n_anomalies", "n_issues", "n_metric_anomalies", *means)


@query("c04_reachability", "with recursive ed as (select distinct source, target from {trade_edges}), hop as (select source as root, target as node_id, 1 as dist from ed union select h.root, e.target, h.dist + 1 from hop h join ed e on e.source = h.node_id where h.dist < 25) select root, node_id, min(dist) as dist from hop group by 1, 2")
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.operators.graph_algo import reachability

    return reachability(relation(spark, sf_dir, "trade_edges"), relation(spark, sf_dir, "trade_nodes")).select("root", "node_id", "dist")


@query("c05_graph_scores", f"with recursive {SQL_C5} select node_id, round(score, 6) as score from sc where score > 0")
def c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    return C.graph_scores(e["nd"], e["edges"], e["an"], e["iss"], e["mt"]).select("node_id", F.round("score", 6).alias("score"))


@query(
    "c06_propagation_paths",
    f"""with recursive {SQL_C}, rv as (select target as s, source as t from ie),
        hops as (select pr.node_id as root, rv.t as n, 1 as d from pr join rv on rv.s = pr.node_id union select h.root, rv.t, h.d + 1 from hops h join rv on rv.s = h.n where h.d < 25),
        far as (select root, n, min(d) as d from hops group by 1, 2),
        par as (select f.root, f.n, min(case when f.d = 1 then f.root else p.n end) as up from far f left join rv on rv.t = f.n left join far p on p.root = f.root and p.n = rv.s and p.d = f.d - 1 where f.n <> f.root and (f.d = 1 or p.n is not null) group by 1, 2),
        walk as (select root, n, 0 as k, n as at_node from par union all select w.root, w.n, w.k + 1, par.up from walk w join par on par.root = w.root and par.n = w.at_node where w.at_node <> w.root),
        pos as (select n, at_node, min(row(root, k)) as f from walk group by 1, 2)
        select n as node_id, string_agg(at_node, '>' order by f) as path from pos group by n""",
)
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    problems = C.problem_nodes(e["an"], e["iss"], e["mt"])
    inside = C.problem_subgraph(problems, e["edges"])[1]
    return C.propagation_paths(inside, problems).select("node_id", F.array_join("path", ">").alias("path"))


SQL_C7 = PROBLEMS + """, ed as (select distinct source, target from {trade_edges}), f as (select nd.node_id, nd.health, coalesce(i.n, 0) as n_issues, coalesce(i.s, 0) as mean_severity, coalesce(a.n, 0) as n_anomalies, coalesce(a.s, 0) as mean_anomaly,
    coalesce(m.n, 0) as n_metric_anomalies, coalesce(m.s, 0) as mean_metric, (select count(*) from ed where target = nd.node_id) as in_degree, (select count(*) from ed where source = nd.node_id) as out_degree
    from nd left join (select node_id, count(*) as n, avg(score * severity / 5) as s from an group by 1) a using (node_id) left join (select node_id, count(*) as n, avg(severity / 5) as s from iss group by 1) i using (node_id) left join (select node_id, count(*) as n, avg(score) as s from mt group by 1) m using (node_id))"""
FEATURE_SQL = ", ".join(f"round(cast({c} as double), 6) as {c}" for c in C.FEATURES if c not in ("degree_ratio", "total_degree"))


@query("c07_node_features", f"with {SQL_C7} select node_id, {FEATURE_SQL}, round(case when out_degree > 0 then in_degree / out_degree else cast(in_degree as double) end, 6) as degree_ratio, cast(in_degree + out_degree as double) as total_degree from f")
def c07(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    return C.node_features(e["nd"], e["edges"], e["an"], e["iss"], e["mt"]).select("node_id", *[F.round(c, 6).alias(c) for c in C.FEATURES])


def observed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of customers from their orders up to a day, and as label what their later orders show.

    Large orders are log anomalies, urgent ones issues, open ones metric anomalies; a root cause is a
    customer with two urgent failed orders or more afterwards. Features never see the later orders.
    """
    nodes, edges = relation(spark, sf_dir, "geo_nodes").where("kind in ('Function', 'Pod')"), relation(spark, sf_dir, "geo_edges")
    of = nodes.select("node_id", F.substring_index("name", "-", -1).cast("long").alias("k"))
    orders = relation(spark, sf_dir, "orders").join(of, F.col("o_custkey") == F.col("k"))
    before, after = orders.where("o_orderdate < timestamp'1998-05-01'"), orders.where("o_orderdate >= timestamp'1998-05-01'")
    severity = (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("severity")
    an = before.where("o_totalprice > 200000").select("node_id", F.least(F.lit(1.0), F.col("o_totalprice") / 500_000).alias("score"), severity)
    iss = before.where("o_orderpriority in ('1-URGENT', '2-HIGH')").select("node_id", severity)
    mt = before.where("o_orderstatus = 'O'").select("node_id", F.least(F.lit(1.0), F.col("o_totalprice") / 500_000).alias("score"))
    rows = C.node_features(nodes.select("node_id"), edges, an, iss, mt)
    seen = after.groupBy(F.col("node_id").alias("n")).agg((F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")) >= 2).cast("int").alias("is_root_cause"))
    return rows.join(seen, F.col("node_id") == F.col("n")).drop("n")


@query("c08_train_root_cause_model")
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = C.train_root_cause_model(observed_features(spark, sf_dir))
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "metric string, value double")


@query("c09_ml_scores")
def c09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(observed_features(spark, sf_dir)).withColumn("fold", F.pmod(F.xxhash64("node_id"), F.lit(2)))
    # Each half is scored by the model of the other.
    scored = [C.ml_scores(C.train_root_cause_model(rows.where(F.col("fold") == 1 - i))[0], rows.where(F.col("fold") == i)) for i in (0, 1)]
    return scored[0].union(scored[1])


@query(
    "c10_combine_scores",
    "with g as (select node_id, seq % 7 / 7.0 as s from {geo_nodes} where seq % 2 = 0), m as (select node_id, seq % 5 / 5.0 as s from {geo_nodes} where seq % 3 = 0) select coalesce(g.node_id, m.node_id) as node_id, round(case when coalesce(m.s, 0) > 0 then 0.4 * coalesce(g.s, 0) + 0.6 * m.s else coalesce(g.s, 0) end, 6) as score from g full join m on g.node_id = m.node_id",
)
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = relation(spark, sf_dir, "geo_nodes")
    g = nodes.where("seq % 2 = 0").select("node_id", (F.col("seq") % 7 / 7.0).alias("score"))
    m = nodes.where("seq % 3 = 0").select("node_id", (F.col("seq") % 5 / 5.0).alias("score"))
    return C.combine_scores(g, m).select("node_id", F.round("score", 6).alias("score"))


POLICIES = "pol(policy, types, patterns, sev, score) as (values ('restart_pod', ['single_point_of_failure', 'unreachable_service'], ['crash', 'memory_error', 'cpu_error'], 3, 0.7), ('scale_up', ['high_fanin', 'missing_autoscaling'], ['cpu_error'], 3, 0.7), ('restart_database', ['database_single_instance'], ['database_error'], 4, 0.8))"


@query("e01_match_issue_policies", f"with {POLICIES} select issue_id, policy from {{issues}} join pol on list_contains(types, type) and severity >= sev")
def e01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.match_issue_policies(relation(spark, sf_dir, "issues"), E.policy_table(spark))


@query("e02_match_anomaly_policies", f"with {POLICIES} select seq, policy from {{anomalies}} a join pol on list_contains(patterns, pattern_name) and severity >= sev and a.score >= pol.score")
def e02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.match_anomaly_policies(relation(spark, sf_dir, "anomalies"), E.policy_table(spark))


ATTEMPTS = "select o_custkey as item, o_orderpriority as policy, o_orderdate as ts, o_orderkey as seq, o_totalprice > 200000 as failed from {orders}"


@query(
    "e03_attempt_plan",
    f"""with a as ({ATTEMPTS}), r as (select *, coalesce(sum(cast(failed as integer)) over (partition by item, policy order by ts, seq rows between unbounded preceding and 1 preceding), 0) as c from a)
        select seq, cast(c as bigint) as retry_count, case when c >= 2 then 'skipped' when failed then 'failed' else 'succeeded' end as planned_status, case when c + 1 < 2 and failed then ts + interval 60 second end as due_at from r""",
)
def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = spark.sql(ATTEMPTS, orders=relation(spark, sf_dir, "orders"))
    return E.attempt_plan(attempts, F.lit(2), F.lit(60)).select("seq", "retry_count", "planned_status", "due_at")


RESULTS = "select o_orderkey as seq, o_orderdate as ts, case o_orderstatus when 'F' then 'failed' when 'O' then 'succeeded' else 'skipped' end as status from {orders}"


@query("e04_get_results", f"select seq, status from ({RESULTS}) r where ts >= timestamp '1997-01-01 00:00:00' and status = 'failed' order by ts desc, seq desc limit 500")
def e04(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = spark.sql(RESULTS, orders=relation(spark, sf_dir, "orders"))
    return E.get_results(results, count=500, since=datetime.datetime(1997, 1, 1), status="failed").select("seq", "status")


@query("e05_success_rate", f"select round(coalesce(avg(case when status = 'succeeded' then 1.0 else 0.0 end), 0), 6) as success_rate from ({RESULTS}) r where ts >= timestamp '1998-01-01 00:00:00'")
def e05(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = spark.sql(RESULTS, orders=relation(spark, sf_dir, "orders"))
    return E.success_rate(results, since=datetime.datetime(1998, 1, 1)).select(F.round("success_rate", 6).alias("success_rate"))


@query(
    "e06_render_commands",
    "select issue_id, 'kubectl rollout restart deployment/' || service || ' -n prod' as command from {issues} where type = 'single_point_of_failure' and severity >= 3 union all select issue_id, 'kubectl scale deployment/' || service || ' -n prod --replicas=3' from {issues} where type in ('high_fanin', 'missing_autoscaling') and severity >= 3 union all select issue_id, 'kubectl rollout restart statefulset/' || service || ' -n prod' from {issues} where type = 'database_single_instance' and severity >= 4",
)
def e06(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, policies = relation(spark, sf_dir, "issues"), E.policy_table(spark)
    matched = E.match_issue_policies(issues, policies).join(issues, "issue_id").join(F.broadcast(policies.select(F.col("name").alias("policy"), "command")), "policy")  # the catalogue
    return matched.select("issue_id", E.render(F.col("command"), SERVICE=F.col("service"), NAMESPACE=F.lit("prod"), REPLICAS=F.lit(3)).alias("command"))


CONF = "cf as (select issue_type, action_id, count(*) as n, avg(case when success then 1.0 else 0.0 end) as confidence from {experiences} group by 1, 2 having count(*) >= 3)"
AVAIL = "av as (select distinct x.seq as state_id, x.issue_type, a.* from {experiences} x join {actions} a on a.target_type = 'service')"
PRED = AVAIL + ", pk as (select av.*, cf.confidence as c from av left join cf using (issue_type, action_id)), pd as (select state_id, coalesce(arg_max(action_id, (c, -lib_seq)) filter (where c >= 0.7), arg_min(action_id, (risk_level, lib_seq))) as action_id, coalesce(max(c) filter (where c >= 0.7), 0.5) as confidence from pk group by state_id)"


@query("e07_rule_confidence", f"with {CONF} select issue_type, action_id, n, round(confidence, 6) as confidence from cf")
def e07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rule_confidence(relation(spark, sf_dir, "experiences")).withColumn("confidence", F.round("confidence", 6))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "experiences").select(F.col("seq").alias("state_id"), "issue_type", "severity", F.array("service").alias("affected_services"))


def _available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(E.available_actions(_states(spark, sf_dir), relation(spark, sf_dir, "actions")))


@query("e08_available_actions", f"with {AVAIL} select state_id, action_id from av")
def e08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _available(spark, sf_dir).select("state_id", "action_id")


@query("e09_predict_action", f"with {CONF}, {PRED} select state_id, action_id, round(confidence, 6) as confidence from pd")
def e09(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.predict_action(_available(spark, sf_dir), E.rule_confidence(relation(spark, sf_dir, "experiences")))
    return out.withColumn("confidence", F.round("confidence", 6))


@query(
    "e10_recommend_action",
    f"""with {CONF}, {PRED}, fx as (select state_id, 'P' as action_id, 0.6 as confidence from pd where state_id % 2 = 0)
        select pd.state_id, case when fx.confidence > pd.confidence then fx.action_id else pd.action_id end as action_id, round(greatest(pd.confidence, coalesce(fx.confidence, 0)), 6) as confidence, case when fx.confidence > pd.confidence then 'fixed' else 'rules' end as learner
        from pd left join fx using (state_id)""",
)
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    available = _available(spark, sf_dir)
    rules = E.predict_action(available, E.rule_confidence(relation(spark, sf_dir, "experiences"))).selectExpr("state_id", "action_id", "confidence", "'rules' as learner", "0 as learner_seq")
    fixed = available.where("state_id % 2 = 0").selectExpr("state_id", "'P' as action_id", "cast(0.6 as double) as confidence", "'fixed' as learner", "1 as learner_seq").distinct()
    out = E.recommend_action(rules.union(fixed), available)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("e11_state_features", "select seq as state_id, round(severity * 10.0, 6) || '|' || round(severity * 2.5, 6) || '|' || round(severity / 5.0, 6) || '|0.1|0.0' as features from {experiences}")
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("severity")
    states = _states(spark, sf_dir).withColumns({"metrics": F.create_map(F.lit("memory"), s * 2.5, F.lit("cpu"), s * 10.0), "previous_actions": F.array().cast("array<string>")})
    return E.state_features(states).select("state_id", F.array_join(F.transform("features", lambda x: F.round(x, 6).cast("string")), "|").alias("features"))


@query(
    "e12_system_state_vector",
    f"""with {PROBLEMS}, t as (select (select count(*) from iss) as i_n, (select sum(severity / 5) from iss) as i_s, (select count(*) from an) as a_n, (select sum(score) from an) as a_s, (select count(*) from mt) as m_n, (select sum(score) from mt) as m_s)
        select round(least(1.0, (i_s + a_s + m_s) / (i_n + a_n + m_n)), 6) as s0, least(1.0, i_n / 10) as s1, round(i_s / i_n, 6) as s2, least(1.0, a_n / 10) as s3, round(a_s / a_n, 6) as s4, least(1.0, m_n / 10) as s5, round(m_s / m_n, 6) as s6, cast(0 as double) as s7, cast(0 as double) as s8, cast(0.5 as double) as s9 from t""",
)
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    out = E.system_state_vector(e["iss"], e["an"], e["mt"], e["mt"].where("false"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


BEFORE = "[value / 100, value / 50, value / 25]"


@query(
    "e13_transition_reward",
    f"with v as (select seq, len(list_filter({BEFORE}, lambda x: x > 0.7)) as b, len(list_filter([value / 200, value / 80], lambda x: x > 0.7)) as a from {{metrics}}) select seq, cast(10.0 * (b - a) - 2.0 * a - 1.0 + case when a = 0 then 20.0 else 0.0 end as double) as reward from v",
)
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return relation(spark, sf_dir, "metrics").select("seq", E.transition_reward(F.array(v / 100, v / 50, v / 25), F.array(v / 200, v / 80)).alias("reward"))


FLAGGED = "select seq, value / 60 as z_score, value > 150 as is_anomaly, 'metric' as detector from {metrics}"


@query("e14_anomalies_to_issues", f"select row_number() over (order by seq) as issue_id, 'metric_anomaly' as type, cast(least(5, floor(2 * z_score)) as integer) as severity, seq from ({FLAGGED}) f where is_anomaly")
def e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.anomalies_to_issues(spark.sql(FLAGGED, metrics=relation(spark, sf_dir, "metrics")), ["seq"]).select("issue_id", "type", "severity", "seq")


@query("e15_incident_pipeline", f"with {CONF}, {PRED} select i.issue_id, pd.action_id, round(pd.confidence, 6) as confidence, case when pd.action_id is null then 'detected' else 'mitigating' end as status from {{issues}} i left join pd on pd.state_id = i.issue_id")
def e15(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = E.predict_action(_available(spark, sf_dir), E.rule_confidence(relation(spark, sf_dir, "experiences"))).selectExpr("state_id", "action_id", "confidence", "'rules' as learner")
    issues = relation(spark, sf_dir, "issues").withColumn("status", F.lit("detected"))
    return E.incident_pipeline(issues, predicted).select("issue_id", "action_id", F.round("confidence", 6).alias("confidence"), "status")


@query(
    "e16_remediation_outcomes",
    "select i.issue_id, x.action_id, case when x.success then 'mitigated' else 'failed' end as issue_status, cast(case when x.success then 1.0 else -0.5 end as double) as reward, 'first|' || x.action_id as next_actions, case when x.success then 'healthy' else 'degraded' end as next_health from {issues} i join {experiences} x on x.seq = i.issue_id",
)
def e16(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = relation(spark, sf_dir, "issues").withColumn("previous_actions", F.array(F.lit("first")))
    outcomes = relation(spark, sf_dir, "experiences").select(F.col("seq").alias("issue_id"), "action_id", "success")
    return E.remediation_outcomes(issues, outcomes).withColumn("next_actions", F.array_join("next_actions", "|"))


@query("e17_match_rule_table", "select issue_id, r.action from {issues} i join (values ('cpu_spike', 3, 'Scale Service'), ('memory_leak', 4, 'Restart Service'), ('error_spike', 3, 'Rollback Deployment'), ('disk_full', 4, 'Clear Cache')) r(t, m, action) on i.type = r.t and i.severity >= r.m")
def e17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.match_rule_table(relation(spark, sf_dir, "issues"), E.rule_table(spark))


@query("e18_q_policy", "select issue_id, case type when 'cpu_spike' then 'Scale Service' when 'memory_leak' then 'Restart Service' end as action, case type when 'cpu_spike' then 0.8 when 'memory_leak' then 0.9 end as value from {issues}")
def e18(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = relation(spark, sf_dir, "issues").select("issue_id", F.concat("type", F.lit("_critical")).alias("state"))
    return E.q_policy(states).select("issue_id", "action", "value")
