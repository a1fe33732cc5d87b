"""Checks of a service graph that emit issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.operators.cycles import list_cycles
from lantern.operators.graph_algo import articulation_points, cycle_search, degrees, unlisted_cycles, weak_components, without_leaves
from lantern.runtime import cut, in_order, lookup, written

#: Fixed: parts of kinds and attribute names that the checks look for.
DATABASE_PARTS = ("db", "database", "sql", "nosql", "redis", "memcached", "cache")
REPLICA_PARTS = ("replica", "replication", "cluster")
SCALE_PARTS = ("scale", "auto", "replica")
RUNNING_PARTS = ("service", "deployment", "instance", "function", "container")


def _kind(default: str) -> Column:
    return F.coalesce("kind", F.lit(default))


def _issue(rows: DataFrame, type_: str, severity: int, description: Column, nodes: Column, metadata: Column, edges: Column | None = None) -> DataFrame:
    no_edges = F.array().cast("array<struct<source:string,target:string>>")
    return rows.select(
        F.lit(type_).alias("type"), F.lit(severity).alias("severity"), description.alias("description"), nodes.alias("affected_nodes"),
        (no_edges if edges is None else edges).alias("affected_edges"), metadata.alias("metadata"), F.lit("detected").alias("status"),
    )


def _meta(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]) if values else F.create_map().cast("map<string,string>")


def _label() -> Column:
    return F.concat(F.coalesce("name", "node_id"), F.lit(" ("), _kind("unknown"), F.lit(")"))


def single_points_of_failure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An issue for each articulation point of the graph without directions, with its degrees.

    The edges are written once for the rounds and the degrees, which are counted for the points alone.
    """
    edges = written(edges.select("source", "target"))
    return _points_issues(nodes, edges, articulation_points(nodes, edges))


def _points_issues(nodes: DataFrame, edges: DataFrame, points: DataFrame) -> DataFrame:
    points = cut(points)
    found = lookup(nodes, degrees(points, edges, few=True).withColumnRenamed("node_id", "__point"), "node_id = __point", how="inner")
    text = F.concat(F.lit("Single point of failure detected: "), _label())
    return _issue(found, "single_point_of_failure", 4, text, F.array("node_id"), _meta(incoming_connections=F.col("in_degree"), outgoing_connections=F.col("out_degree")))


def _cycle_issues(cycles: DataFrame) -> DataFrame:
    after = F.concat(F.slice("nodes", F.lit(2), F.size("nodes") - 1), F.slice("nodes", 1, 1))
    ring = F.zip_with("nodes", after, lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    text = F.concat(F.lit("Circular dependency detected: "), F.array_join("nodes", " -> "), F.lit(" -> "), F.get("nodes", 0))
    return _issue(cycles, "circular_dependency", 3, text, F.col("nodes"), _meta(cycle_length=F.size("nodes")), ring)


def circular_dependencies(edges: DataFrame, max_length: int | None = None) -> tuple[DataFrame, bool]:
    """An issue for each simple cycle, or for those of 2 to ``max_length`` nodes; and whether longer ones may exist."""
    cycles, paths, _, _ = cycle_search(edges, max_length)
    return _cycle_issues(cycles), not paths.isEmpty()


def _by_component(parts: DataFrame, text: str, **metadata: Column) -> DataFrame:
    size = F.size("members")
    told = F.concat(F.lit(f"Circular dependency detected: {text} among "), size.cast("string"), F.lit(" services: "), F.array_join("members", ", "))
    return _issue(parts, "circular_dependency", 3, told, F.col("members"), _meta(component_size=size, **metadata))


def all_circular_dependencies(edges: DataFrame, max_length: int | None = None, max_paths: int = 5_000_000, most: int = 10_000) -> DataFrame:
    """An issue for each simple cycle, and one for each strong component that holds cycles beyond the bounds, with all its nodes.

    Without ``max_length`` each edge that a cycle begins with lists up to ``most`` cycles of any length
    (``listed_per_edge`` in the component's issue, which is there only if one was not listed). With it,
    and in components too large for one task's search, cycles are listed by length: ``listed_to`` is the
    length up to which they have issues of their own.
    """
    issues, rest = None, edges
    if max_length is None:
        cycles, members, rest = list_cycles(edges, most)
        issues = _cycle_issues(cycles).unionByName(_by_component(members, f"more than {most} cycles from one edge", listed_per_edge=F.lit(most)))
        if rest.isEmpty():
            return issues
    cycles, paths, live, listed = cycle_search(rest, max_length, max_paths)
    issues = _cycle_issues(cycles) if issues is None else issues.unionByName(_cycle_issues(cycles))
    if paths.isEmpty():
        return issues
    return issues.unionByName(_by_component(unlisted_cycles(paths, live), f"cycles of more than {listed}", listed_to=F.lit(listed)))


def orphaned_services(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An issue for each node without any edge; a loop is an edge."""
    alone = nodes.join(edges.select(F.explode(F.array("source", "target")).alias("node_id")), "node_id", "left_anti")
    return _issue(alone, "orphaned_service", 2, F.concat(F.lit("Orphaned service detected: "), _label()), F.array("node_id"), _meta())


def _fan(nodes: DataFrame, edges: DataFrame, threshold: int, out: bool) -> DataFrame:
    own, other = ("source", "target") if out else ("target", "source")
    # Neighbours are gathered only of the nodes whose issue lists them.
    distinct = edges.select("source", "target").distinct()
    high = distinct.groupBy(F.col(own).alias("__node")).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    listed = distinct.join(high, F.col(own) == F.col("__node")).groupBy(F.col("__node").alias("node_id")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(other)).alias("others"))
    rows = nodes.join(listed, "node_id")
    word, way = ("fanout", "outgoing") if out else ("fanin", "incoming")
    text = F.concat(F.lit(f"High {word} detected: "), _label(), F.lit(" has "), F.col("n").cast("string"), F.lit(f" {way} connections"))
    pair = (lambda x: F.struct(F.col("node_id").alias("source"), x.alias("target"))) if out else (lambda x: F.struct(x.alias("source"), F.col("node_id").alias("target")))
    return _issue(rows, f"high_{word}", 2, text, F.concat(F.array("node_id"), "others"), _meta(**{f"{word}_count": F.col("n")}), F.transform("others", pair))


def high_fanout(nodes: DataFrame, edges: DataFrame, threshold: int = 10) -> DataFrame:
    """An issue for each node that calls ``threshold`` others or more."""
    return _fan(nodes, edges, threshold, True)


def high_fanin(nodes: DataFrame, edges: DataFrame, threshold: int = 10) -> DataFrame:
    """An issue for each node that ``threshold`` others or more call."""
    return _fan(nodes, edges, threshold, False)


def network_partitions(nodes: DataFrame, edges: DataFrame, most: int = 50_000, bare: tuple[DataFrame, list[DataFrame]] | None = None) -> DataFrame:
    """An issue for each weak component if there are several, numbered by their first node.

    A component of more than ``most`` nodes gets an issue for each of its pieces, into which its nodes are
    dealt by a hash of their id; such issues tell ``piece`` and ``pieces`` and have the component's index and
    size. So no row and no task gets all nodes of a large component.
    """
    parts = cut(weak_components(nodes.select("node_id", "seq"), edges, bare).join(nodes.select("node_id", "seq"), "node_id"))
    sized = parts.groupBy(F.col("component").alias("__c")).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    numbered = in_order(sized, "first", "__c", name="i").withColumn("pieces", F.ceil(F.col("n") / most).cast("long"))
    several = numbered.limit(2).count() > 1
    dealt = lookup(parts, numbered, "component = __c", how="inner").withColumn("piece", F.pmod(F.xxhash64("node_id"), F.col("pieces")))
    found = dealt.where(F.lit(several)).groupBy("component", "piece").agg(F.array_sort(F.collect_list("node_id")).alias("members"), *[F.first(c).alias(c) for c in ("i", "n", "pieces")])
    text = F.concat(F.lit("Network partition detected: Component "), F.col("i").cast("string"), F.lit(" with "), F.col("n").cast("string"), F.lit(" services"))
    whole = _meta(component_index=F.col("i") - 1, component_size=F.col("n"))
    told = F.when(F.col("pieces") > 1, F.map_concat(whole, _meta(piece=F.col("piece"), pieces=F.col("pieces")))).otherwise(whole)
    return _issue(found, "network_partition", 3, text, F.col("members"), told)


def _names_hold(column: str, parts: tuple[str, ...]) -> Column:
    return F.coalesce(F.exists(F.map_keys(column), lambda k: F.lower(k).rlike("|".join(parts))), F.lit(False))


def _any_name(parts: tuple[str, ...]) -> Column:
    return _names_hold("attrs_str", parts) | _names_hold("attrs_json", parts)


def _type_or_kind(nodes: DataFrame) -> Column:
    return F.lower(F.coalesce("type", "kind", F.lit("")) if "type" in nodes.columns else _kind(""))


def database_single_instance(nodes: DataFrame) -> DataFrame:
    """An issue for each database or cache of which no string attribute's name tells of replicas."""
    is_database = F.coalesce(F.col("category").isin("database", "cache"), F.lit(False)) | _type_or_kind(nodes).rlike("|".join(DATABASE_PARTS))
    rows = nodes.where(is_database & ~_names_hold("attrs_str", REPLICA_PARTS))
    text = F.concat(F.lit("Database single instance detected: "), F.coalesce("name", "node_id"), F.lit(" is not replicated"))
    return _issue(rows, "database_single_instance", 4, text, F.array("node_id"), _meta())


def missing_health_checks(nodes: DataFrame) -> DataFrame:
    """An issue for each running kind of node, outside three categories, of which no attribute's name tells of health."""
    skipped = F.coalesce(F.col("category").isin("network", "security", "storage"), F.lit(False))
    rows = nodes.where(~skipped & ~_any_name(("health",)) & _type_or_kind(nodes).rlike("|".join(RUNNING_PARTS)))
    text = F.concat(F.lit("Missing health check detected: "), F.coalesce("name", "node_id"), F.lit(" does not have a health check configured"))
    return _issue(rows, "missing_health_check", 3, text, F.array("node_id"), _meta())


def missing_autoscaling(nodes: DataFrame) -> DataFrame:
    """An issue for each running kind of node, outside four categories, of which no attribute's name tells of scaling."""
    skipped = F.coalesce(F.col("category").isin("network", "security", "storage", "data"), F.lit(False))
    rows = nodes.where(~skipped & ~_any_name(SCALE_PARTS) & _type_or_kind(nodes).rlike("|".join(RUNNING_PARTS)))
    text = F.concat(F.lit("Missing autoscaling detected: "), F.coalesce("name", "node_id"), F.lit(" does not have autoscaling configured"))
    return _issue(rows, "missing_autoscaling", 2, text, F.array("node_id"), _meta())


def detect_issues(nodes: DataFrame, edges: DataFrame, max_cycle: int | None = None, threshold: int = 10, nodes_written: bool = False) -> DataFrame:
    """The issues of all nine checks, in their order by ``check``; cycles longer than a given ``max_cycle`` by their component.

    The graph is written once, its nodes unless ``nodes_written``, so that the driver never plans the checks over what it was
    made from and each check reads the columns that it needs. Leaves are taken off once for single points and partitions. Issues are not
    written here, as their reader runs them.
    """
    nodes, edges = nodes if nodes_written else written(nodes), written(edges.select("source", "target"))
    bare = without_leaves(edges)
    checks = [
        _points_issues(nodes, edges, articulation_points(nodes, edges, bare=bare)), all_circular_dependencies(edges, max_cycle), orphaned_services(nodes, edges), high_fanout(nodes, edges, threshold),
        high_fanin(nodes, edges, threshold), network_partitions(nodes, edges, bare=bare), database_single_instance(nodes), missing_health_checks(nodes), missing_autoscaling(nodes),
    ]
    out = None
    for i, one in enumerate(checks):
        one = one.withColumn("check", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def merge_issues(known: DataFrame, new: DataFrame, key: tuple[str, ...] = ("type", "detected_at")) -> DataFrame:
    """The issues of both, a new row in place of a known one with the same key; ``is_new`` marks keys never seen."""
    old = known.select(*key).distinct().withColumn("__old", F.lit(True))
    fresh = new.join(old, list(key), "left").withColumn("is_new", F.col("__old").isNull()).drop("__old")
    kept = known.join(new.select(*key).distinct(), list(key), "left_anti").withColumn("is_new", F.lit(False))
    return fresh.unionByName(kept, allowMissingColumns=True)
