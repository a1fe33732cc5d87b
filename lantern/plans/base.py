"""Registry of queries with their SQL, and the relations that both are built on.

A relation is SQL text that Spark and DuckDB both run; ``{name}`` stands for a table or another
relation. Operators get relations as DataFrames; the SQL of a query gets them as common table
expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

RELATIONS = {
    # events as log lines: errors give ten texts, one for each default pattern; each day's lines fall in twenty minutes
    "logs": """
        select event_id as seq, date_trunc('day', ts) + (event_id % 1200) * interval '1' second as ts, 'svc-' || (user_id % 12) as service,
               case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' else 'INFO' end as level,
               case when event_type = 'error' then case event_id % 10
                        when 0 then 'Error: request Failed' when 1 then 'OutOfMemory: memory limit reached'
                        when 2 then 'high CPU usage detected' when 3 then 'Disk full on volume'
                        when 4 then 'Connection refused by peer' when 5 then 'Unauthorized: Permission denied'
                        when 6 then 'Database error during commit' when 7 then 'HTTP 503 returned'
                        when 8 then 'HTTP 404 returned' else 'Fatal: Segmentation fault' end
                    when event_type = 'purchase' and event_id % 10 = 7 then 'HTTP 502 from upstream'
                    else 'request served' end as message
        from {events}""",
    # events as metric samples
    "metrics": """
        select ts, 'svc-' || (user_id % 12) as service, event_type as metric_name,
               case event_type when 'error' then 'counter' when 'click' then 'histogram' else 'gauge' end as metric_type,
               value, 'r' || (user_id % 3) as region, event_id as seq
        from {events}""",
    # events as monotone counters: one more for each event of a service and type
    "counters": """
        select ts, 'svc-' || (user_id % 12) as service, event_type as name, 'ns' || (user_id % 3) as namespace, event_id as seq,
               cast(count(*) over (partition by user_id % 12, event_type order by ts, event_id rows between unbounded preceding and current row) as double) as value
        from {events}""",
    # suppliers and customers under nations under regions
    "geo_nodes": """
        select 'ns' || r_regionkey || '/region-' || r_regionkey as node_id, cast(r_regionkey as bigint) as seq, 'region-' || r_regionkey as name,
               'ns' || r_regionkey as namespace, 'Region' as kind, 'network' as category, 'aws' as provider, 'name,kind' as str_attrs, 'ports' as json_attrs
        from {region}
        union all
        select 'ns' || n_regionkey || '/nation-' || n_nationkey || case n_nationkey % 3 when 0 then '-service' when 1 then '-db' else '' end,
               1000000000000 + n_nationkey, 'nation-' || n_nationkey, 'ns' || n_regionkey,
               case n_nationkey % 4 when 0 then 'Service' when 1 then 'Deployment' when 2 then 'rds' else 'StatefulSet' end,
               case n_nationkey % 5 when 0 then 'database' when 1 then 'cache' when 2 then 'compute' when 3 then 'data' else 'api' end,
               case n_nationkey % 3 when 0 then 'aws' when 1 then 'azure' else 'google' end,
               case when n_nationkey % 4 = 0 then 'name,kind,replicas' else 'name,kind' end,
               case when n_nationkey % 3 = 0 then 'ports,healthPath' else 'ports' end
        from {nation}
        union all
        select 'ns' || n_regionkey || '/supplier-' || s_suppkey, 2000000000000 + s_suppkey, 'supplier-' || s_suppkey, 'ns' || n_regionkey,
               case s_suppkey % 3 when 0 then 'Service' when 1 then 'Deployment' else 'redis' end,
               case s_suppkey % 4 when 0 then 'database' when 1 then 'compute' when 2 then 'data' else 'storage' end,
               case s_suppkey % 4 when 0 then 'aws' when 1 then 'azure' when 2 then 'google' else 'other' end,
               case s_suppkey % 5 when 0 then 'name,kind,clusterName' when 1 then 'name,kind,autoScale' else 'name,kind' end,
               case s_suppkey % 7 when 0 then 'ports,health' else 'ports' end
        from {supplier} join {nation} on s_nationkey = n_nationkey
        union all
        select 'ns' || n_regionkey || '/customer-' || c_custkey, 3000000000000 + c_custkey, 'customer-' || c_custkey, 'ns' || n_regionkey,
               case c_custkey % 2 when 0 then 'Function' else 'Pod' end, 'compute', 'aws', 'name,kind', 'ports'
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    # customers with a positive balance and suppliers call their nation, nations their region; the rest stays alone
    "geo_edges": """
        select s.node_id as source, n.node_id as target, 'uses' as type, cast(0.9 as double) as confidence, s.seq as emit_seq
        from {geo_nodes} s join {supplier} on s.name = 'supplier-' || s_suppkey join {geo_nodes} n on n.name = 'nation-' || s_nationkey
        where s_suppkey % 17 <> 3
        union all
        select c.node_id, n.node_id, 'calls', cast(0.7 as double), c.seq
        from {geo_nodes} c join {customer} on c.name = 'customer-' || c_custkey join {geo_nodes} n on n.name = 'nation-' || c_nationkey
        where c_acctbal > 0
        union all
        select n.node_id, r.node_id, 'belongs', cast(null as double), n.seq
        from {geo_nodes} n join {nation} on n.name = 'nation-' || n_nationkey join {geo_nodes} r on r.name = 'region-' || n_regionkey""",
    # customers and the suppliers that they order from; grows with the orders
    "order_edges": """
        select distinct 'ns' || c.n_regionkey || '/customer-' || o_custkey as source, 'ns' || s.n_regionkey || '/supplier-' || l_suppkey as target
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {nation} c on c_nationkey = c.n_nationkey
        join {supplier} on l_suppkey = s_suppkey join {nation} s on s_nationkey = s.n_nationkey""",
    # customers in teams of eight that call each other by their urgent orders: rings of up to eight nodes, whose number grows with the orders
    "team_edges": """
        select distinct 'c-' || o_custkey as source, 'c-' || (cast(floor(o_custkey / 8) as bigint) * 8 + cast(floor(o_orderkey / 3) as bigint) % 8) as target
        from {orders} where o_orderpriority like '1%'""",
    # manifests: a service per nation, a deployment per supplier, config and secret per region
    "svc": """
        select n_nationkey as k, cast(n_nationkey as bigint) as seq, 'ns' || n_regionkey as namespace, 'nation-' || n_nationkey as name,
               'ns' || n_regionkey || '/nation-' || n_nationkey as node_id, n_regionkey as r from {nation}""",
    "dep": """
        select s_suppkey as k, 1000 + s_suppkey as seq, 'ns' || n_regionkey as namespace, 'supplier-' || s_suppkey as name, 'ns' || n_regionkey || '/supplier-' || s_suppkey as node_id,
               s_nationkey as n, n_regionkey as r,
               case s_suppkey % 8 when 0 then 'postgres:15' when 1 then 'REDIS:7' when 2 then 'memcached' when 3 then 'rabbitmq' when 4 then 'nginx' when 5 then 'tomcat' when 6 then 'kube-proxy' else 'own' end as image,
               case when s_suppkey % 5 = 0 then 'nation-' || s_nationkey || ', nation-' || ((s_nationkey + 1) % 25) || '.ns9, ghost-' || (s_suppkey % 3) end as deps,
               case when s_suppkey % 4 = 1 then 'NATION-' || s_nationkey || '_URL' else 'TARGET' end as env_name,
               case s_suppkey % 4 when 2 then 'http://nation-' || s_nationkey || '.example.com/x' when 3 then 'http://nation-' || s_nationkey || '.ns' || n_regionkey || '.svc.cluster.local:80' when 1 then '' else 'plain' end as env_value,
               case when s_suppkey % 6 = 0 then 'nation-' || s_nationkey || '.ns' || n_regionkey || '.svc' end as arg
        from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "grp_nodes": """
        select node_id, seq, name, namespace, kind, category from {geo_nodes}
        union all select node_id || '-pod', seq + 5000000000000, name || '-pod', namespace, case when seq % 2 = 0 then 'Pod' else 'Deployment' end, category
        from {geo_nodes} where seq >= 2000000000000 and seq < 3000000000000""",
    "grp_edges": """
        select source, target, type, confidence, emit_seq from {geo_edges}
        union all select source || '-pod', target, 'pod', 0.5, emit_seq + 7000000000000 from {geo_edges} where type = 'uses'
        union all select source || '-pod', source, 'self', 0.1, emit_seq + 8000000000000 from {geo_edges} where type = 'uses'""",
    # nations that sell to each other, with measures and roles
    "flow": """
        select c.c_nationkey as buyer, s.s_nationkey as seller, sum(l_extendedprice * (1 - l_discount)) as revenue
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} c on o_custkey = c.c_custkey join {supplier} s on l_suppkey = s.s_suppkey
        group by c.c_nationkey, s.s_nationkey""",
    "trade_nodes": """
        select 'ns' || n_regionkey || '/' || case n_nationkey % 6 when 0 then 'web-' when 1 then 'api-' when 2 then 'postgres-' when 3 then 'redis-' when 4 then 'kafka-' else 'worker-' end || n_nationkey
               || case n_nationkey % 4 when 0 then '-service' when 1 then '-deployment' else '' end as node_id,
               cast(n_nationkey as bigint) as seq,
               case n_nationkey % 6 when 0 then 'web-' when 1 then 'api-' when 2 then 'postgres-' when 3 then 'redis-' when 4 then 'kafka-' else 'worker-' end || n_nationkey as name,
               'ns' || n_regionkey as namespace,
               case n_nationkey % 4 when 0 then 'Service' when 1 then 'Deployment' when 2 then 'StatefulSet' else 'Pod' end as kind,
               case n_nationkey % 6 when 0 then 'frontend' when 1 then 'backend' when 2 then 'database' when 3 then 'cache' when 4 then 'queue' else 'api' end as category,
               cast(coalesce(m.n, 0) as double) / 100 as request_rate, round(coalesce(m.late, 0), 6) as latency_p95, round(coalesce(m.err, 0), 6) as error_rate,
               case when n_nationkey % 5 = 0 then 1.2 else n_nationkey % 10 / 10.0 end * cast(1 as double) as cpu_usage, cast(n_nationkey * 60 as double) as memory_usage,
               n_nationkey % 3 as n_ports
        from {nation} left join (
            select c_nationkey as k, count(*) as n, avg(o_totalprice) / 400000 as late, avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) / 4 as err
            from {orders} join {customer} on o_custkey = c_custkey group by c_nationkey) m on m.k = n_nationkey""",
    "trade_edges": """
        select b.node_id as source, s.node_id as target, 'sells' as type, round(f.revenue / t.total, 6) as confidence, b.seq * 1000 + s.seq as emit_seq
        from {flow} f join (select buyer, sum(revenue) as total from {flow} group by buyer) t on f.buyer = t.buyer
        join {trade_nodes} b on b.seq = f.buyer join {trade_nodes} s on s.seq = f.seller
        where f.revenue >= 0.055 * t.total and f.buyer <> f.seller""",
    # orders as outcomes of actions
    "experiences": """
        select o_orderkey as seq, o_orderpriority as issue_type, o_orderstatus as action_id, o_totalprice > 150000 as success,
               o_orderdate as ts, 'service/' || (o_custkey % 7) as service, cast(1 + o_orderkey % 5 as int) as severity
        from {orders}""",
    "actions": """
        select action_id, case action_id when 'F' then 'service' when 'O' then 'deployment' else 'service' end as target_type,
               case action_id when 'F' then 3 when 'O' then 1 else 2 end as risk_level,
               case action_id when 'F' then 1 when 'O' then 2 else 3 end as lib_seq
        from (select distinct o_orderstatus as action_id from {orders}) a""",
    # anomalies of log lines and issues by hour, as input of matching and ranking
    "issues": """
        select event_id as issue_id, case event_id % 6 when 0 then 'single_point_of_failure' when 1 then 'high_fanin' when 2 then 'database_single_instance'
                   when 3 then 'missing_autoscaling' when 4 then 'cpu_spike' else 'memory_leak' end as type,
               cast(1 + event_id % 5 as int) as severity, 'svc-' || (user_id % 12) as service, ts as detected_at
        from {events} where event_type = 'error'""",
    "anomalies": """
        select event_id as seq, case event_id % 4 when 0 then 'crash' when 1 then 'cpu_error' when 2 then 'database_error' else 'auth_error' end as pattern_name,
               cast(1 + event_id % 5 as int) as severity, round((value - floor(value)), 6) as score, 'svc-' || (user_id % 12) as service, ts
        from {events} where event_type in ('error', 'click')""",
}


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def _with_doubles(text: str) -> str:
    """``text`` with its numbers with a point as doubles: Spark would average decimals to five digits, where DuckDB gives doubles."""
    return re.sub(r"('[^']*')|(?<![\w.])(\d+\.\d+)(?![\w.])", lambda m: m[1] or f"{m[2]}D", text)


def relation(spark: SparkSession, sf_dir: str, name: str, **known: DataFrame) -> DataFrame:
    """A table or relation as a DataFrame; relations that it names are taken from ``known`` where they are there already."""
    if name in known:
        return known[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _with_doubles(RELATIONS[name])
    return spark.sql(text, **{x: relation(spark, sf_dir, x, **known) for x in _names(text)})


def with_relations(text: str) -> str:
    """``text`` with the relations that its ``{name}``s ask for as common table expressions ahead of it."""
    parts: dict[str, str] = {}

    def need(name: str) -> None:
        if name in RELATIONS and name not in parts:
            for x in _names(RELATIONS[name]):
                need(x)
            parts[name] = f"{name} as ({RELATIONS[name].format(**{x: x for x in _names(RELATIONS[name])})})"

    names = _names(text)
    for x in names:
        need(x)
    body = text.format(**{x: x for x in names}).strip()
    if not parts:
        return body
    head = ", ".join(parts.values())
    if body.startswith("with recursive "):
        return f"with recursive {head}, {body[len('with recursive ') :]}"
    if body.startswith("with "):
        return f"with {head}, {body[len('with ') :]}"
    return f"with {head} {body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL where SQL can express it."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = with_relations(sql)
        return function

    return add


def with_attrs(nodes: DataFrame) -> DataFrame:
    """Nodes whose attribute names come as text, with the attribute maps that operators read."""
    as_map = "map_from_arrays(split({0}, ','), transform(split({0}, ','), x -> '1'))"
    return nodes.selectExpr("*", as_map.format("str_attrs") + " as attrs_str", as_map.format("json_attrs") + " as attrs_json").drop("str_attrs", "json_attrs")
