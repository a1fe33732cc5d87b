"""Queries that build, infer and check graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators import checks as D
from lantern.operators import graph_algo as GA
from lantern.operators import graph_build as G
from lantern.operators import graph_infer as M
from lantern.operators import suggest as R
from lantern.plans.base import query, relation, with_attrs
from lantern.runtime import cut, written


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, json`` of the manifests that the relations ``svc`` and ``dep`` describe."""
    svc, dep, region = (relation(spark, sf_dir, x) for x in ("svc", "dep", "region"))
    meta = lambda name, ns, **more: F.struct(name.alias("name"), ns.alias("namespace"), *[v.alias(k) for k, v in more.items()])
    tier = lambda k: F.concat(F.lit("t"), k % 2)
    services = svc.select("seq", F.to_json(F.struct(
        F.lit("Service").alias("kind"), meta(F.col("name"), F.col("namespace")).alias("metadata"),
        F.struct(F.create_map(F.lit("app"), "name", F.lit("tier"), tier(F.col("k"))).alias("selector")).alias("spec"))).alias("json"))
    container = F.struct(
        F.lit("main").alias("name"), F.col("image"), F.array(F.struct(F.col("env_name").alias("name"), F.col("env_value").alias("value"))).alias("env"),
        F.array(F.lit("run")).alias("command"), F.when(F.col("arg").isNotNull(), F.array("arg")).alias("args"), F.array(F.struct(F.lit("cfg").alias("name")), F.struct(F.lit("sec").alias("name"))).alias("volumeMounts"))
    cfg = F.when(F.col("k") % 2 == 0, F.struct(F.concat(F.lit("config-"), "r").alias("name")))
    sec = F.when(F.col("k") % 3 == 0, F.struct(F.concat(F.lit("secret-"), "r").alias("secretName")))
    none_c, none_s = F.lit(None).cast("struct<name:string>"), F.lit(None).cast("struct<secretName:string>")
    volumes = F.array(F.struct(F.lit("cfg").alias("name"), cfg.alias("configMap"), none_s.alias("secret")), F.struct(F.lit("sec").alias("name"), none_c.alias("configMap"), sec.alias("secret")))
    notes = F.when(F.col("deps").isNotNull(), F.create_map(F.lit("example.org/dependencies"), "deps"))
    template = F.struct(F.struct(notes.alias("annotations")).alias("metadata"), F.struct(F.array(container).alias("containers"), volumes.alias("volumes")).alias("spec"))
    workloads = dep.select("seq", F.to_json(F.struct(
        F.lit("Deployment").alias("kind"), meta(F.col("name"), F.col("namespace"), labels=F.create_map(F.lit("app"), F.concat(F.lit("nation-"), "n"), F.lit("tier"), tier(F.col("k")))).alias("metadata"),
        F.struct(template.alias("template")).alias("spec"))).alias("json"))
    r = F.col("r_regionkey")
    space = F.concat(F.lit("ns"), r)
    kinds = F.explode(F.array(F.struct(F.lit("ConfigMap").alias("kind"), F.lit("config-").alias("p")), F.struct(F.lit("Secret").alias("kind"), F.lit("secret-").alias("p"))))
    config = region.select(r.alias("r_regionkey"), kinds.alias("x")).select((F.lit(10**10) + r).alias("seq"), F.to_json(F.struct(
        F.col("x.kind").alias("kind"), meta(F.concat("x.p", r), space).alias("metadata"), F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")).alias("data"))).alias("json"))
    backend = lambda s, n, p: F.struct(s.alias("service"), n.alias("serviceName"), p.alias("servicePort"))
    new = backend(F.struct(F.concat(F.lit("nation-"), r).alias("name"), F.struct(F.lit(80).alias("number")).alias("port")), F.lit(None).cast("string"), F.lit(None).cast("string"))
    old = backend(F.lit(None).cast("struct<name:string,port:struct<number:int>>"), F.concat(F.lit("nation-"), r + 5), F.lit("http"))
    paths = F.array(F.struct(F.lit("/a").alias("path"), F.lit("Exact").alias("pathType"), new.alias("backend")), F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("pathType"), old.alias("backend")))
    rule = F.struct(F.when(r % 2 == 0, F.concat(F.lit("h"), r)).alias("host"), F.struct(paths.alias("paths")).alias("http"))
    ingress = region.select((F.lit(2 * 10**10) + r).alias("seq"), F.to_json(F.struct(
        F.lit("Ingress").alias("kind"), meta(F.concat(F.lit("ingress-"), r), space).alias("metadata"), F.struct(F.array(rule).alias("rules")).alias("spec"))).alias("json"))
    return services.union(workloads).union(config).union(ingress)


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.parse_manifests(manifests(spark, sf_dir))


def parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Resources and nodes for operators that read both: manifests are parsed once."""
    found = cut(resources(spark, sf_dir))
    return found, G.build_nodes(found.drop("labels"))


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.build_nodes(resources(spark, sf_dir).drop("labels"))


def _edges(df: DataFrame) -> DataFrame:
    return df.select("source", "target", "type")


@query(
    "g01_build_nodes",
    """select node_id, name, namespace, 'Service' as kind from {svc} union all select node_id, name, namespace, 'Deployment' from {dep}
       union all select 'ns' || r_regionkey || '/' || p || r_regionkey, p || r_regionkey, 'ns' || r_regionkey, k from {region}, (values ('config-', 'ConfigMap'), ('secret-', 'Secret'), ('ingress-', 'Ingress')) x(p, k)""",
)
def g01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).select("node_id", "name", "namespace", "kind")


@query("g02_merge_edges", "select source, target, case when emit_seq % 2 = 0 then 'later' else type end as type, confidence from {geo_edges}")
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = relation(spark, sf_dir, "geo_edges")
    later = edges.where("emit_seq % 2 = 0").selectExpr("source", "target", "'later' as type", "cast(null as double) as confidence", "emit_seq + 10000000000000 as emit_seq")
    dangling = edges.selectExpr("source", "'nowhere/' || target as target", "type", "confidence", "emit_seq")
    merged = G.merge_edges(edges.union(later).union(dangling), relation(spark, sf_dir, "geo_nodes"))
    return merged.select("source", "target", "type", "confidence")


DEPS = "d as (select seq, node_id, namespace, trim(unnest(string_split(deps, ','))) as d from {dep} where deps is not null), t as (select seq, node_id as source, case when d like '%.%' then split_part(d, '.', 2) || '/' || split_part(d, '.', 1) else namespace || '/' || d end as target from d)"


@query("g03_explicit_dependencies", f"with {DEPS} select source, target, 'explicit-dependency' as type from t")
def g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(G.explicit_dependencies(*parsed(spark, sf_dir))[0])


@query("g03_created_services", f"with {DEPS} select target as node_id, 'Service' as kind, min(seq) as seq from t where target not in (select node_id from {{svc}} union all select node_id from {{dep}}) group by target")
def g03_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.explicit_dependencies(*parsed(spark, sf_dir))[1].select("node_id", "kind", "seq")


DNS_ARG = "select node_id as source, 'ns' || r || '/nation-' || n as target, 'service-dependency' as type from {dep} where k % 6 = 0"


@query("g04_dns_dependencies", f"select node_id as source, 'ns' || r || '/nation-' || n as target, 'service-dependency' as type from {{dep}} where k % 4 = 3 union all {DNS_ARG}")
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(G.dns_dependencies(G.texts(resources(spark, sf_dir))))


@query("g05_url_dependencies", "select d.node_id as source, s.node_id as target, 'url-dependency' as type from {dep} d join {svc} s on contains(s.node_id, 'nation-' || d.n) where d.k % 4 = 2")
def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, nodes = parsed(spark, sf_dir)
    return _edges(G.url_dependencies(G.texts(found), nodes))


@query("g06_env_name_dependencies", "select d.node_id as source, s.node_id as target, 'implied-dependency' as type from {dep} d join {svc} s on contains(s.node_id, 'nation-' || d.n) where d.k % 4 = 1")
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(G.env_name_dependencies(*parsed(spark, sf_dir)))


@query("g07_command_dependencies", DNS_ARG)
def g07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(G.dns_dependencies(G.command_texts(resources(spark, sf_dir))))


@query(
    "g08_config_dependencies",
    "select node_id as source, namespace || '/config-' || r as target, 'config-dependency' as type from {dep} where k % 2 = 0 union all select node_id, namespace || '/secret-' || r, 'secret-dependency' from {dep} where k % 3 = 0",
)
def g08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(G.config_dependencies(resources(spark, sf_dir)))


@query("g09_selector_edges", "select s.node_id as source, d.node_id as target, 'service-selector' as type from {svc} s join {dep} d on d.n = s.k and d.k % 2 = s.k % 2")
def g09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(G.selector_edges(resources(spark, sf_dir)))


@query(
    "g10_ingress_edges",
    """select 'ns' || r_regionkey || '/ingress-' || r_regionkey as source, 'ns' || r_regionkey || '/nation-' || (r_regionkey + o) as target, case when r_regionkey % 2 = 0 then 'h' || r_regionkey else '*' end as host,
       path, path_type, port from {region}, (values (0, '/a', 'Exact', '80'), (5, '/', 'Prefix', 'http')) x(o, path, path_type, port)""",
)
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ingress_edges(resources(spark, sf_dir)).select("source", "target", "host", "path", "path_type", "port")


@query("g11_config_attributes", "select 'ns' || r_regionkey || '/' || p || r_regionkey as node_id, 'a,b' as data_keys, c as category from {region}, (values ('config-', 'config'), ('secret-', 'security')) x(p, c)")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.config_attributes(resources(spark, sf_dir)).select("node_id", F.array_join("data_keys", ",").alias("data_keys"), "category")


@query(
    "g12_category_from_image",
    "select node_id, case k % 8 when 0 then 'database' when 1 then 'database' when 2 then 'cache' when 3 then 'queue' when 4 then 'api' when 5 then 'compute' when 6 then 'kubernetes' end as category from {dep}",
)
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resources(spark, sf_dir).where("kind = 'Deployment'")
    return rows.select("node_id", G.category_from_image(F.col("doc.spec.template.spec.containers")[0]["image"]).alias("category"))


@query("g17_graph_counts", "select (select count(*) from {geo_nodes}) as n_nodes, (select count(*) from (select distinct source, target from {geo_edges}) e) as n_edges")
def g17(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = relation(spark, sf_dir, "geo_nodes"), relation(spark, sf_dir, "geo_edges")
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.select("source", "target").distinct().agg(F.count("*").alias("n_edges")))


@query("g17_neighbours", "select distinct source as node_id, 'in' as side from {geo_edges} where target = 'ns2/nation-2' union all select distinct target, 'out' from {geo_edges} where source = 'ns2/nation-2'")
def g17_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = relation(spark, sf_dir, "geo_edges")
    side = lambda df, s: df.withColumn("side", F.lit(s))
    return side(G.predecessors(edges, "ns2/nation-2"), "in").union(side(G.successors(edges, "ns2/nation-2"), "out"))


@query("g17_set_attribute", "select node_id, case when node_id = 'ns2/nation-2' then 'changed' else category end as category from {geo_nodes}")
def g17_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.set_attribute(relation(spark, sf_dir, "geo_nodes"), "ns2/nation-2", "category", "changed").select("node_id", "category")


BASE = "b as (select *, regexp_replace(regexp_extract(node_id, '[^/]+$'), '(-service|-deployment|-pod|-container|-db|-cache|-queue)$', '') as base from {grp_nodes})"
PRIMARY = BASE + ", p as (select * from (select *, row_number() over (partition by base order by case when kind in ('Deployment', 'StatefulSet', 'DaemonSet') then 0 when kind = 'Service' then 1 else 2 end, seq) as i from b) x where i = 1)"


@query("g18_group_services", f"with {BASE} select base, count(*) as n, min(node_id) as first_id from b group by base")
def g18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.group_services(relation(spark, sf_dir, "grp_nodes")).groupBy("base").agg(F.count("*").alias("n"), F.min("node_id").alias("first_id"))


@query("g19_primary_nodes", f"with {PRIMARY} select base, node_id, kind from p")
def g19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.primary_nodes(G.group_services(relation(spark, sf_dir, "grp_nodes"))).select("base", "node_id", "kind")


@query("g20_simplify_graph", f"with {BASE} select s.base as source, t.base as target, arg_min(e.type, e.emit_seq) as type from {{grp_edges}} e join b s on s.node_id = e.source join b t on t.node_id = e.target where s.base <> t.base group by 1, 2")
def g20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(G.simplify_graph(relation(spark, sf_dir, "grp_nodes"), relation(spark, sf_dir, "grp_edges"))[1])


def sql_role(name: str) -> str:
    return "case " + " ".join(f"when regexp_matches({name}, '{'|'.join(parts)}') then '{r}'" for r, parts in G.ROLES) + " end"


TRADE_BASE = "b as (select *, regexp_replace(regexp_extract(node_id, '[^/]+$'), '(-service|-deployment|-pod|-container|-db|-cache|-queue)$', '') as base from {trade_nodes})"
CALLS = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in G.CALLS)


@query(
    "g21_infer_relationships",
    f"with {TRADE_BASE}, r as (select node_id, {sql_role('base')} as role from b) select x.node_id as source, y.node_id as target, 'inferred-dependency' as type, cast(c.confidence as double) as confidence from r x join (values {CALLS}) c(a, b, confidence) on c.a = x.role join r y on y.role = c.b where x.node_id <> y.node_id",
)
def g21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.infer_relationships(relation(spark, sf_dir, "trade_nodes")).select("source", "target", "type", "confidence")


def _embedding(nodes: str) -> str:
    def part(column: str, most: int, step: int, offset: int) -> str:
        return f"select node_id, (i - 1) * {step} + {offset} as pos, ascii(substr(lower({column}), i, 1)) / 255.0 as w from (select *, unnest(generate_series(1, least({most}, length({column})))) as i from {nodes}) z"

    return (
        f"v as (select node_id, cast(pos as integer) as pos, sum(w) as w from ({part('name', 10, 1, 0)} union all {part('kind', 5, 2, 0)} union all {part('category', 5, 2, 1)}) u group by 1, 2), "
        "e as (select node_id, pos, w / sqrt(sum(w * w) over (partition by node_id)) as weight from v)"
    )


@query("m01_service_embedding", f"with {_embedding('{geo_nodes}')} select node_id, pos, round(weight, 6) as weight from e")
def m01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.service_embedding(relation(spark, sf_dir, "geo_nodes")).select("node_id", "pos", F.round("weight", 6).alias("weight"))


def _direction() -> str:
    has = lambda c, x: f"contains({c}.category, '{x}')"
    rules = []
    for p, q in (("frontend", "backend"), ("backend", "database"), ("backend", "cache")):
        rules += [f"when {has('a', p)} and {has('b', q)} then 1", f"when {has('b', p)} and {has('a', q)} then -1"]
    rules += [f"when {has('a', 'api')} and not {has('b', 'api')} then 1", f"when {has('b', 'api')} and not {has('a', 'api')} then -1"]
    rules += [f"when not {has('a', 'queue')} and {has('b', 'queue')} then 1", f"when not {has('b', 'queue')} and {has('a', 'queue')} then -1"]
    rules += ["when contains(b.name, a.name) and contains(a.name, 'client') then 1", "when contains(a.name, b.name) and contains(b.name, 'client') then -1"]
    rules += ["when a.n_ports > 0 and b.n_ports = 0 then -1", "when b.n_ports > 0 and a.n_ports = 0 then 1"]
    return "case " + " ".join(rules) + " else case when a.node_id < b.node_id then 1 else -1 end end"


PAIRS = f"c as (select x.node_id as x, y.node_id as y, sum(x.weight * y.weight) as cosine from e x join e y on x.pos = y.pos and x.node_id < y.node_id group by 1, 2), w as (select a.node_id as a, b.node_id as b, cosine, {_direction()} as dir from c join {{trade_nodes}} p on p.node_id = c.x join {{trade_nodes}} q on q.node_id = c.y join {{trade_nodes}} a on a.node_id = case when p.seq <= q.seq then c.x else c.y end join {{trade_nodes}} b on b.node_id = case when p.seq <= q.seq then c.y else c.x end where cosine > 0.85)"
M2 = f"with {_embedding('{trade_nodes}')}, {PAIRS} select case when dir = 1 then a else b end as source, case when dir = 1 then b else a end as target, 'ml-inferred' as type, round(cosine, 6) as confidence from w"


@query("m02_embedding_edges", M2)
def m02(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = relation(spark, sf_dir, "trade_nodes")
    return M.embedding_edges(nodes, M.service_embedding(nodes), 0.85).withColumn("confidence", F.round("confidence", 6))


@query("m03_relationship_direction", f"select a.node_id as a_id, b.node_id as b_id, {_direction()} as direction from {{trade_nodes}} a join {{trade_nodes}} b on a.seq < b.seq")
def m03(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = relation(spark, sf_dir, "trade_nodes").select(F.struct("node_id", "seq", "name", "category", "n_ports").alias("n"))
    pairs = nodes.select(F.col("n").alias("a")).join(nodes.select(F.col("n").alias("b")), F.expr("a.seq < b.seq"))
    return pairs.select(F.col("a.node_id").alias("a_id"), F.col("b.node_id").alias("b_id"), M.relationship_direction().alias("direction"))


M4 = "select a.node_id as source, b.node_id as target, 'traffic-inferred' as type, round(least(a.request_rate, b.request_rate) / greatest(a.request_rate, b.request_rate), 6) as confidence from {trade_nodes} a join {trade_nodes} b on a.node_id <> b.node_id and a.latency_p95 > b.latency_p95 and least(a.request_rate, b.request_rate) / greatest(a.request_rate, b.request_rate) > 0.8"
M5 = "select a.node_id as source, b.node_id as target, 'error-inferred' as type, cast(0.7 as double) as confidence from {trade_nodes} a join {trade_nodes} b on a.error_rate > b.error_rate where a.error_rate > 0.05 and b.error_rate > 0.05"
M6 = "select a.node_id as source, b.node_id as target, 'deployment-inferred' as type, cast(0.6 as double) as confidence from {trade_nodes} a join {trade_nodes} b on a.node_id <> b.node_id and a.namespace = b.namespace and split_part(a.name, '-', 1) = split_part(b.name, '-', 1) where a.kind in ('Deployment', 'StatefulSet', 'DaemonSet') and b.kind in ('Deployment', 'StatefulSet', 'DaemonSet')"


@query("m04_traffic_edges", M4)
def m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.traffic_edges(relation(spark, sf_dir, "trade_nodes")).withColumn("confidence", F.round("confidence", 6))


@query("m05_error_edges", M5)
def m05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.error_edges(relation(spark, sf_dir, "trade_nodes"))


DEPLOY = M6.replace("{trade_nodes} a", "{grp_nodes} a").replace("{trade_nodes} b", "{grp_nodes} b")


@query("m06_deployment_edges", DEPLOY)
def m06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.deployment_edges(relation(spark, sf_dir, "grp_nodes"))


@query("m07_prune_candidates", "select e.source, e.target, e.type, coalesce(coalesce(e.confidence, 0) <= 0.8 and e.type <> 'direct' and coalesce(r.confidence, 0) > coalesce(e.confidence, 0), false) as prune_candidate from {trade_edges} e left join {trade_edges} r on r.source = e.target and r.target = e.source")
def m07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.prune_candidates(relation(spark, sf_dir, "trade_edges")).select("source", "target", "type", "prune_candidate")


M8 = M2.split(" select case when dir")[0] + f""", allsteps as (select source, target, type, confidence, 0 as step from {{trade_edges}} union all select case when dir = 1 then a else b end, case when dir = 1 then b else a end, 'ml-inferred', cosine, 1 from w
    union all select source, target, type, confidence, 2 from ({M4.replace('round(', '(').replace(', 6)', ')')}) union all select source, target, type, confidence, 3 from ({M5}) union all select source, target, type, confidence, 4 from ({M6})),
    g as (select source, target, arg_max(type, step) as type, arg_max(confidence, step) as confidence from allsteps group by 1, 2)
    select e.source, e.target, e.type, round(e.confidence, 5) as confidence, coalesce(e.confidence <= 0.8 and r.confidence > e.confidence, false) as prune_candidate from g e left join g r on r.source = e.target and r.target = e.source"""


@query("m08_enhance_graph", M8)
def m08(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.enhance_graph(relation(spark, sf_dir, "trade_nodes"), relation(spark, sf_dir, "trade_edges"), 0.85)
    return out.select("source", "target", "type", F.round("confidence", 5).alias("confidence"), "prune_candidate")


def geo(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return with_attrs(relation(spark, sf_dir, "geo_nodes")), relation(spark, sf_dir, "geo_edges")


def geo_once(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``geo`` with the nodes written once, as the edges name them six times, for queries that read both more than once."""
    nodes = written(relation(spark, sf_dir, "geo_nodes"))
    return with_attrs(nodes), relation(spark, sf_dir, "geo_edges", geo_nodes=nodes)


def _issues(df: DataFrame) -> DataFrame:
    return df.select("type", "severity", "description", F.array_join("affected_nodes", "|").alias("nodes"))


LABEL = "name || ' (' || kind || ')'"
UNDIRECTED = "u as (select source as a, target as b from {geo_edges} where source <> target union select target, source from {geo_edges} where source <> target)"
SQL_D1 = f"select 'single_point_of_failure' as type, 4 as severity, 'Single point of failure detected: ' || {LABEL} as description, node_id as nodes from {{geo_nodes}} join (select a from u group by a having count(*) >= 2) x on a = node_id"
SQL_D3 = f"select 'orphaned_service' as type, 2 as severity, 'Orphaned service detected: ' || {LABEL} as description, node_id as nodes from {{geo_nodes}} where node_id not in (select source from {{geo_edges}}) and node_id not in (select target from {{geo_edges}})"


def _fan(own: str, other: str, word: str, way: str, nodes: str, edges: str, least: int) -> str:
    return f"select 'high_{word}' as type, 2 as severity, 'High {word} detected: ' || {LABEL} || ' has ' || n || ' {way} connections' as description, node_id || '|' || others as nodes from {nodes} join (select {own} as k, count(*) as n, string_agg({other}, '|' order by {other}) as others from (select distinct source, target from {edges}) d group by {own} having count(*) >= {least}) f on k = node_id"


SQL_D5 = _fan("target", "source", "fanin", "incoming", "{geo_nodes}", "{geo_edges}", 10)
SQL_D6 = "select 'network_partition' as type, 3 as severity, 'Network partition detected: Component ' || row_number() over (order by f, c) || ' with ' || n || ' services' as description, members as nodes from (select c, min(seq) as f, count(*) as n, string_agg(node_id, '|' order by node_id) as members from comp join {geo_nodes} on n0 = node_id group by c) g"
REACH = UNDIRECTED + ", hop as (select node_id as n0, node_id as m from {geo_nodes} union select h.n0, u.b from hop h join u on u.a = h.m), comp as (select n0, min(m) as c from hop group by n0)"
RUN = "regexp_matches(lower(kind), 'service|deployment|instance|function|container')"
SQL_D7 = "select 'database_single_instance' as type, 4 as severity, 'Database single instance detected: ' || name || ' is not replicated' as description, node_id as nodes from {geo_nodes} where (category in ('database', 'cache') or regexp_matches(lower(kind), 'db|database|sql|nosql|redis|memcached|cache')) and not regexp_matches(lower(str_attrs), 'replica|replication|cluster')"
SQL_D8 = f"select 'missing_health_check' as type, 3 as severity, 'Missing health check detected: ' || name || ' does not have a health check configured' as description, node_id as nodes from {{geo_nodes}} where category not in ('network', 'security', 'storage') and {RUN} and not regexp_matches(lower(str_attrs || ',' || json_attrs), 'health')"
SQL_D9 = f"select 'missing_autoscaling' as type, 2 as severity, 'Missing autoscaling detected: ' || name || ' does not have autoscaling configured' as description, node_id as nodes from {{geo_nodes}} where category not in ('network', 'security', 'storage', 'data') and {RUN} and not regexp_matches(lower(str_attrs || ',' || json_attrs), 'scale|auto|replica')"


@query("d01_single_points_of_failure", f"with {UNDIRECTED} {SQL_D1}")
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(D.single_points_of_failure(*geo_once(spark, sf_dir)))


CYCLES = "t as (select distinct source, target from {trade_edges} where source <> target), p as (select [source, target] as nodes, target as at from t where source < target union all select list_append(nodes, t.target), t.target from p join t on t.source = p.at where len(nodes) < 5 and t.target > nodes[1] and not list_contains(nodes, t.target))"
SQL_D2 = "select 'circular_dependency' as type, 3 as severity, 'Circular dependency detected: ' || array_to_string(nodes, ' -> ') || ' -> ' || nodes[1] as description, array_to_string(nodes, '|') as nodes from p join t on t.source = p.at and t.target = nodes[1] where len(nodes) <= 4"
# Paths of five nodes begin the longer cycles; where one has a way back without its inner nodes, its strong component has such a cycle.
LONGER = """back as (select nodes, p.at from p where len(nodes) = 5 union select nodes, t.target from back join t on t.source = back.at where t.target > nodes[1] and not list_contains(nodes, t.target)),
    reach as (select source as a, target as b from t union select reach.a, t.target from reach join t on t.source = reach.b), strong as (select x.a as node, least(x.a, min(x.b)) as c from reach x join reach y on y.a = x.b and y.b = x.a group by x.a),
    wide as (select c, count(*) as n, list(node order by node) as members from strong where c in (select s.c from back join t on t.source = back.at and t.target = back.nodes[1] join strong s on s.node = back.nodes[1]) group by c)"""
SQL_LONGER = "select 'circular_dependency', 3, 'Circular dependency detected: cycles of more than 4 among ' || n || ' services: ' || array_to_string(members, ', '), array_to_string(members, '|') from wide"


@query("d02_circular_dependencies", f"with recursive {CYCLES}, {LONGER} {SQL_D2} union all {SQL_LONGER}")
def d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(D.all_circular_dependencies(relation(spark, sf_dir, "trade_edges"), 4))


TEAM_CYCLES = "t as (select source, target from {team_edges} where source <> target), p as (select [source, target] as nodes, target as at from t where source < target union all select list_append(nodes, t.target), t.target from p join t on t.source = p.at where t.target > nodes[1] and not list_contains(nodes, t.target))"


@query("d02_team_cycles", f"with recursive {TEAM_CYCLES} {SQL_D2.replace(' where len(nodes) <= 4', '')}")
def d02_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(D.all_circular_dependencies(relation(spark, sf_dir, "team_edges")))


@query("d02_trade_cycles")
def d02_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of any length of the dense graph of trade: up to 500 from an edge, and its component if there are more."""
    return _issues(D.all_circular_dependencies(relation(spark, sf_dir, "trade_edges"), most=500))


@query("d03_orphaned_services", SQL_D3)
def d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(D.orphaned_services(*geo(spark, sf_dir)))


@query("d04_high_fanout", _fan("source", "target", "fanout", "outgoing", "{trade_nodes}", "{trade_edges}", 3))
def d04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(D.high_fanout(relation(spark, sf_dir, "trade_nodes"), relation(spark, sf_dir, "trade_edges"), 3))


@query("d04_high_fanout_orders", _fan("source", "target", "fanout", "outgoing", "{geo_nodes}", "{order_edges}", 10))
def d04_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(D.high_fanout(geo(spark, sf_dir)[0], relation(spark, sf_dir, "order_edges"), 10))


@query("d05_high_fanin", SQL_D5)
def d05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(D.high_fanin(*geo(spark, sf_dir)))


@query("d06_network_partitions", f"with recursive {REACH} {SQL_D6}")
def d06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(D.network_partitions(*geo(spark, sf_dir)))


@query("d07_database_single_instance", SQL_D7)
def d07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(D.database_single_instance(geo(spark, sf_dir)[0]))


@query("d08_missing_health_checks", SQL_D8)
def d08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(D.missing_health_checks(geo(spark, sf_dir)[0]))


@query("d09_missing_autoscaling", SQL_D9)
def d09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(D.missing_autoscaling(geo(spark, sf_dir)[0]))


ALL = [SQL_D1, SQL_D3, SQL_D5, SQL_D6, SQL_D7, SQL_D8, SQL_D9]
ALL_SQL = f"with recursive {REACH} " + " union all ".join(f"select * from ({x})" for x in ALL)


@query("d10_detect_issues", ALL_SQL)
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(D.detect_issues(*geo_once(spark, sf_dir), nodes_written=True))


@query(
    "d11_merge_issues",
    """with k as (select issue_id, type, detected_at from {issues} where issue_id % 3 <> 0), w as (select issue_id, type, detected_at from {issues} where issue_id % 2 = 0)
       select w.issue_id, w.type, w.issue_id % 3 = 0 as is_new from w union all select k.issue_id, k.type, false from k where issue_id % 2 <> 0""",
)
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = relation(spark, sf_dir, "issues")
    return D.merge_issues(issues.where("issue_id % 3 <> 0"), issues.where("issue_id % 2 = 0")).select("issue_id", "type", "is_new")
