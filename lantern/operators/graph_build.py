"""Nodes and edges of a service graph from manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.runtime import cut

#: Shape of a manifest; what a check doesn't need stays JSON text.
_CONTAINER = "struct<name: string, image: string, env: array<struct<name: string, value: string>>, command: array<string>, args: array<string>, volumeMounts: array<struct<name: string>>>"
_VOLUME = "struct<name: string, configMap: struct<name: string>, secret: struct<secretName: string>>"
_BACKEND = "struct<service: struct<name: string, port: struct<number: string, name: string>>, serviceName: string, servicePort: string>"
MANIFEST = f"""kind string, metadata struct<name: string, namespace: string, labels: map<string,string>>, data map<string,string>,
    spec struct<type: string, selector: string, ports: string, replicas: string,
        template: struct<metadata: struct<annotations: map<string,string>>, spec: struct<containers: array<{_CONTAINER}>, volumes: array<{_VOLUME}>>>,
        rules: array<struct<host: string, http: struct<paths: array<struct<path: string, pathType: string, backend: {_BACKEND}>>>>>>"""
WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet")
#: Fixed: parts of a variable's name that tell of a service.
HINTS = ("_HOST", "_URL", "_ADDR", "_SERVICE", "_ENDPOINT")
#: Fixed: the first list with a part of the image's name gives the category.
IMAGE_CATEGORIES = (
    ("database", ("postgres", "mysql", "mariadb", "mongodb", "redis", "cassandra", "elasticsearch", "couchdb")),
    ("cache", ("redis", "memcached", "hazelcast")),
    ("queue", ("rabbitmq", "kafka", "activemq", "nats")),
    ("api", ("nginx", "httpd", "apache", "traefik", "envoy", "haproxy")),
    ("compute", ("tomcat", "jetty", "wildfly", "websphere", "weblogic")),
    ("kubernetes", ("k8s", "kube", "kubernetes")),
    ("container", ("alpine", "debian", "ubuntu", "centos", "fedora", "busybox")),
)
#: Fixed: suffixes that a group's name goes without; the first that fits is taken off.
SUFFIXES = ("-service", "-deployment", "-pod", "-container", "-db", "-cache", "-queue")
#: Fixed: parts of names that show a role, in order, and which roles call which with what confidence.
ROLES = (
    ("frontend", ("frontend", "ui", "web", "client")),
    ("backend", ("backend", "api", "server")),
    ("database", ("db", "database", "sql", "mongo", "postgres", "mysql")),
    ("cache", ("cache", "redis", "memcached")),
    ("queue", ("queue", "mq", "kafka", "rabbit", "nats")),
)
CALLS = (("frontend", "backend", 0.8), ("backend", "database", 0.9), ("backend", "cache", 0.7), ("backend", "queue", 0.7))


def parse_manifests(documents: DataFrame, json: str = "json") -> DataFrame:
    """``seq, kind, name, namespace, node_id, labels, doc`` of every document that has a kind and a name."""
    parsed = documents.select("seq", F.from_json(json, MANIFEST).alias("doc"))
    meta = F.col("doc.metadata")
    namespace = F.coalesce(meta["namespace"], F.lit("default"))
    return parsed.where("doc.kind is not null and doc.kind <> '' and doc.metadata.name is not null and doc.metadata.name <> ''").select(
        "seq", F.col("doc.kind").alias("kind"), meta["name"].alias("name"), namespace.alias("namespace"), F.concat_ws("/", namespace, meta["name"]).alias("node_id"), meta["labels"].alias("labels"), "doc"
    )


def _last(column: str, order: str = "seq") -> Column:
    """The value of the greatest ``order`` that isn't null."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order))).alias(column)


def build_nodes(resources: DataFrame) -> DataFrame:
    """One row per node id; every attribute by its last writer, the place by the first."""
    attrs = [c for c in resources.columns if c not in ("seq", "node_id", "doc")]
    return resources.groupBy("node_id").agg(F.min("seq").alias("first_seq"), *[_last(c) for c in attrs]).withColumnRenamed("first_seq", "seq")


def merge_edges(candidates: DataFrame, nodes: DataFrame, respect_order: bool = False) -> DataFrame:
    """One row per source and target that are both nodes; every attribute by its last writer.

    With ``respect_order`` an edge counts only if its target was known when it was added.
    """
    known = nodes.select(F.col("node_id").alias("__id"), F.col("seq").alias("__seq")) if respect_order else nodes.select(F.col("node_id").alias("__id"))
    kept = candidates.join(known, F.col("source") == F.col("__id"), "left_semi")
    if respect_order:
        kept = kept.join(known, (F.col("target") == F.col("__id")) & (F.col("__seq") <= F.col("emit_seq")), "left_semi")
    else:
        kept = kept.join(known, F.col("target") == F.col("__id"), "left_semi")
    attrs = [c for c in candidates.columns if c not in ("source", "target", "emit_seq")]
    return kept.groupBy("source", "target").agg(*[_last(c, "emit_seq") for c in attrs], F.min("emit_seq").alias("emit_seq"))


def _containers(resources: DataFrame) -> DataFrame:
    work = resources.where(F.col("kind").isin(*WORKLOADS))
    return work.select("seq", "node_id", "namespace", "doc", F.explode("doc.spec.template.spec.containers").alias("c"))


def explicit_dependencies(resources: DataFrame, nodes: DataFrame, annotation: str = "/dependencies") -> tuple[DataFrame, DataFrame]:
    """Edges that annotations ask for, and the service nodes that they create.

    The annotation's key is ``annotation`` or ends with it; it lists ``name`` or ``name.namespace``,
    parted by commas. Targets that aren't nodes yet become services.
    """
    notes = F.col("doc.spec.template.metadata.annotations")
    listed = F.flatten(F.transform(F.filter(F.map_entries(notes), lambda e: e["key"].endswith(annotation)), lambda e: F.split(e["value"], ",")))
    rows = resources.where(F.col("kind").isin(*WORKLOADS)).select("seq", "node_id", "namespace", F.explode(F.transform(listed, lambda x: F.trim(x))).alias("d")).where("d <> ''")
    name = F.split_part("d", F.lit("."), F.lit(1))
    where = F.when(F.contains("d", F.lit(".")), F.split_part("d", F.lit("."), F.lit(2))).otherwise(F.col("namespace"))
    targets = rows.select("seq", "node_id", name.alias("name"), where.alias("namespace")).withColumn("target", F.concat_ws("/", "namespace", "name"))
    edges = targets.select(F.col("node_id").alias("source"), "target", F.lit("explicit-dependency").alias("type"), F.col("seq").alias("emit_seq"))
    created = targets.join(nodes.select(F.col("node_id").alias("__id")), F.col("target") == F.col("__id"), "left_anti")
    created = created.groupBy(F.col("target").alias("node_id")).agg(F.min("seq").alias("seq"), F.min("name").alias("name"), F.min("namespace").alias("namespace")).withColumn("kind", F.lit("Service"))
    return edges, created


def texts(resources: DataFrame) -> DataFrame:
    """``seq, node_id, text`` of the values, commands and arguments of every container that may name a service."""
    c = _containers(resources)
    none = F.array().cast("array<string>")
    parts = F.concat(F.coalesce(F.transform("c.env", lambda e: e["value"]), none), F.coalesce("c.command", none), F.coalesce("c.args", none))
    return c.select("seq", "node_id", F.explode(parts).alias("text")).where("text is not null and text <> ''")


def command_texts(resources: DataFrame) -> DataFrame:
    """As ``texts``, of commands and arguments only."""
    none = F.array().cast("array<string>")
    return _containers(resources).select("seq", "node_id", F.explode(F.concat(F.coalesce("c.command", none), F.coalesce("c.args", none))).alias("text"))


def dns_dependencies(found: DataFrame, strip_scheme: bool = True) -> DataFrame:
    """Edges to ``namespace/name`` of cluster names ``name.namespace.svc``."""
    bare = F.regexp_replace("text", r"^\w+://", "") if strip_scheme else F.col("text")
    parts = F.split(bare, r"\.")
    space = F.coalesce(F.get(parts, 1), F.lit("default"))
    return found.where(F.contains("text", F.lit(".svc"))).select(
        F.col("node_id").alias("source"), F.concat_ws("/", space, F.get(parts, 0)).alias("target"), F.lit("service-dependency").alias("type"), F.col("seq").alias("emit_seq")
    )


def _services(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'Service'").select(F.col("node_id").alias("target"))


def url_dependencies(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges to the services whose id holds the first label of a URL's host; cluster names are left to ``dns_dependencies``.

    Hosts are few beside texts: distinct labels are matched with services, then looked up by equality.
    """
    host = F.lower(F.split_part(F.regexp_extract("text", r"^https?://([^/:?#]+)", 1), F.lit("."), F.lit(1)))
    urls = found.where(~F.contains("text", F.lit(".svc"))).withColumn("label", host).where("label <> ''")
    return _by_substring(urls, nodes, "url-dependency", lower=False)


def env_name_dependencies(resources: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges to the services whose id holds the first part of a variable's name, of names that tell of a service."""
    names = _containers(resources).select("seq", "node_id", F.explode(F.transform("c.env", lambda e: e["name"])).alias("env"))
    hinted = names.where(F.col("env").rlike("|".join(HINTS))).withColumn("label", F.lower(F.split_part("env", F.lit("_"), F.lit(1)))).where("label <> ''")
    return _by_substring(hinted, nodes, "implied-dependency", lower=True)


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` letters."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _by_substring(rows: DataFrame, nodes: DataFrame, kind: str, lower: bool) -> DataFrame:
    """Labels with the services whose id holds them, joined by each label's rarest run of three letters (the whole of a shorter one)."""
    rows, services = cut(rows.select("node_id", "seq", "label")), cut(_services(nodes))
    text = F.lower("target") if lower else F.col("target")
    index = services.select("target", F.explode(F.concat(*[_grams(text, n) for n in (1, 2, 3)])).alias("__gram"))
    counts = index.groupBy(F.col("__gram").alias("__g")).agg(F.count("*").alias("__n"))
    labels = rows.select(F.col("label").alias("__label")).distinct()
    own = labels.select("__label", F.explode(F.when(F.length("__label") < 3, F.array("__label")).otherwise(_grams(F.col("__label"), 3))).alias("__of"))
    rarest = own.join(counts, F.col("__of") == F.col("__g"), "left").groupBy("__label").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)), "__of")).alias("r"))
    pairs = rarest.select("__label", F.col("r.__of").alias("__of")).join(index, F.col("__of") == F.col("__gram")).where(F.contains(text, F.col("__label"))).select("__label", "target")
    return rows.join(pairs, F.col("label") == F.col("__label")).select(F.col("node_id").alias("source"), "target", F.lit(kind).alias("type"), F.col("seq").alias("emit_seq"))


def config_dependencies(resources: DataFrame) -> DataFrame:
    """Edges to the config maps and secrets whose volumes are mounted; a volume with both counts as the map."""
    mounts = _containers(resources).select("seq", "node_id", "namespace", F.explode("c.volumeMounts.name").alias("m"), "doc")
    volumes = mounts.select("seq", "node_id", "namespace", "m", F.explode("doc.spec.template.spec.volumes").alias("v")).where("v.name = m")
    is_map = F.col("v.configMap").isNotNull()
    name = F.when(is_map, F.col("v.configMap.name")).otherwise(F.col("v.secret.secretName"))
    edges = volumes.withColumn("name", name).where("name <> ''")
    kind = F.when(is_map, "config-dependency").otherwise("secret-dependency")
    return edges.select(F.col("node_id").alias("source"), F.concat_ws("/", "namespace", "name").alias("target"), kind.alias("type"), F.col("seq").alias("emit_seq"))


def selector_edges(resources: DataFrame) -> DataFrame:
    """Edges from services to the workloads whose own labels have every pair of the selector; an empty selector gives none.

    A selector is joined by its rarest pair only, and the workloads found are held against all of it; so
    a label that all have joins nothing unless a selector has no other.
    """
    services = resources.where("kind = 'Service'").select("seq", "node_id", F.from_json("doc.spec.selector", "map<string,string>").alias("s")).where(F.size("s") > 0)
    services = cut(services)
    labelled = resources.where(F.col("kind").isin(*WORKLOADS)).select(F.col("node_id").alias("target"), "labels", F.explode("labels").alias("k", "v"))
    labelled = cut(labelled)
    counts = labelled.groupBy(F.col("k").alias("__k"), F.col("v").alias("__v")).agg(F.count("*").alias("n"))
    wanted = services.select("seq", "node_id", "s", F.explode("s").alias("__wk", "__wv")).join(counts, (F.col("__wk") == F.col("__k")) & (F.col("__wv") == F.col("__v")), "left")
    pairs = F.array_sort(F.transform(F.map_entries("s"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    rarest = wanted.groupBy("seq", "node_id", pairs.alias("pairs")).agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "__wk", "__wv")).alias("r"))
    met = rarest.join(labelled, (F.col("r.__wk") == F.col("k")) & (F.col("r.__wv") == F.col("v")))
    met = met.where(F.forall("pairs", lambda e: F.coalesce(F.try_element_at("labels", e["k"]) == e["v"], F.lit(False))))
    edges = met.groupBy(F.col("node_id").alias("source"), "target").agg(F.min("seq").alias("emit_seq"))
    return edges.select("source", "target", F.lit("service-selector").alias("type"), "emit_seq")


def ingress_edges(resources: DataFrame) -> DataFrame:
    """Edges from ingresses to the services of their paths, in either shape of the interface, with host, path, path type and port."""
    rules = resources.where("kind = 'Ingress'").select("seq", "node_id", "namespace", F.explode("doc.spec.rules").alias("r"))
    paths = rules.select("seq", "node_id", "namespace", "r.host", F.explode("r.http.paths").alias("p"))
    new = F.col("p.backend.service").isNotNull()
    service = F.when(new, F.col("p.backend.service.name")).otherwise(F.col("p.backend.serviceName"))
    port = F.when(new, F.coalesce("p.backend.service.port.number", "p.backend.service.port.name")).otherwise(F.col("p.backend.servicePort"))
    return paths.withColumn("__service", service).where("__service <> ''").select(
        F.col("node_id").alias("source"), F.concat_ws("/", "namespace", "__service").alias("target"), F.lit("ingress-route").alias("type"),
        F.coalesce("host", F.lit("*")).alias("host"), F.coalesce("p.path", F.lit("/")).alias("path"), F.coalesce("p.pathType", F.lit("Prefix")).alias("path_type"), port.alias("port"), F.col("seq").alias("emit_seq"),
    )


def config_attributes(resources: DataFrame) -> DataFrame:
    """``node_id, data_keys, category`` of config maps and secrets with data; values aren't kept."""
    rows = resources.where("kind in ('ConfigMap', 'Secret') and size(doc.data) > 0")
    category = F.when(F.col("kind") == "ConfigMap", "config").otherwise("security")
    return rows.select("node_id", F.array_sort(F.map_keys("doc.data")).alias("data_keys"), category.alias("category"))


def category_from_image(image: Column) -> Column:
    """The category of the first list with a part that the image's name holds, else null."""
    out = F.lit(None).cast("string")
    for category, parts in reversed(IMAGE_CATEGORIES):
        out = F.when(F.lower(image).rlike("|".join(parts)), category).otherwise(out)
    return out


def node_lookup(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def successors(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where(F.col("source") == node_id).select(F.col("target").alias("node_id")).distinct()


def predecessors(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where(F.col("target") == node_id).select(F.col("source").alias("node_id")).distinct()


def set_attribute(nodes: DataFrame, node_id: str, name: str, value) -> DataFrame:
    """Nodes with an attribute of one node set."""
    old = F.col(name) if name in nodes.columns else F.lit(None)
    return nodes.withColumn(name, F.when(F.col("node_id") == node_id, F.lit(value)).otherwise(old))


def base_name(node_id: Column) -> Column:
    """The last part of an id without the first suffix of the list that it ends with."""
    name = F.element_at(F.split(node_id, "/"), -1)
    # No suffix ends with another one, so the first that fits is the only one.
    return F.regexp_replace(name, f"({'|'.join(SUFFIXES)})$", "")


def group_services(nodes: DataFrame) -> DataFrame:
    """Nodes with the ``base`` name of their group."""
    return nodes.withColumn("base", base_name(F.col("node_id")))


def primary_nodes(grouped: DataFrame) -> DataFrame:
    """One node per group: the first workload, else the first service, else the first node."""
    rank = F.when(F.col("kind").isin(*WORKLOADS), 0).when(F.col("kind") == "Service", 1).otherwise(2)
    first = F.row_number().over(Window.partitionBy("base").orderBy(rank, "seq"))
    return grouped.withColumn("__first", first).where("__first = 1").drop("__first")


def simplify_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One node per group with its primary's attributes; edges between groups, the first of each pair, without loops."""
    grouped = group_services(nodes)
    map_to = grouped.select("node_id", "base")
    renamed = (
        edges.join(map_to.select(F.col("node_id").alias("source"), F.col("base").alias("s")), "source")
        .join(map_to.select(F.col("node_id").alias("target"), F.col("base").alias("t")), "target")
        .where("s <> t")
    )
    attrs = [c for c in edges.columns if c not in ("source", "target", "emit_seq")]
    first = renamed.groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(*[F.min_by(c, "emit_seq").alias(c) for c in attrs], F.min("emit_seq").alias("emit_seq"))
    return primary_nodes(grouped), first


def role(name: Column) -> Column:
    """The first role of which the lower-cased name holds a part, else null."""
    out = F.lit(None).cast("string")
    for r, parts in reversed(ROLES):
        out = F.when(F.lower(name).rlike("|".join(parts)), r).otherwise(out)
    return out


def infer_relationships(nodes: DataFrame) -> DataFrame:
    """Edges between the primary nodes of groups whose roles call each other, with the rule's confidence."""
    primary = primary_nodes(group_services(nodes)).select("node_id", "seq", role(F.col("base")).alias("role")).where("role is not null")
    rules = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("confidence"), F.lit(i).alias("rule")) for i, (a, b, c) in enumerate(CALLS)])
    callers = primary.select(F.col("node_id").alias("source"), "role", F.explode(rules).alias("r")).where("r.a = role")
    called = primary.select(F.col("node_id").alias("target"), F.col("role").alias("b"))
    pairs = callers.join(called, F.col("r.b") == F.col("b")).where("source <> target")
    return pairs.select("source", "target", F.lit("inferred-dependency").alias("type"), "r.confidence", F.col("r.rule").cast("long").alias("emit_seq"))
