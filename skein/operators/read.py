"""Read operators: find, traverse, path, typed steps, evidence, explain, shared concepts, changes, ranking, views."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import string_of, text_of
from ..model import KEY, Graph, saved
from .filters import EdgeFilter, adjacency, edge_cond, every

#: A frontier of at most so many ids is broadcast to the adjacency; a larger one is joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000


def _small(ids: DataFrame) -> tuple[DataFrame, int]:
    n = ids.count()
    return (F.broadcast(ids) if n <= MAX_BROADCAST_IDS else ids), n


def find(
    g: Graph,
    node_type: str | None = None,
    content_type: str | None = None,
    dimension: str | None = None,
    has_property: str | None = None,
    property_equals: tuple[str, str] | None = None,
    edge_filter: EdgeFilter | None = None,
    offset: int = 0,
    limit: int | None = None,
    total: bool = False,
) -> DataFrame:
    """Nodes that meet all predicates. ``property_equals``: key and JSON value.

    Sorted by id where a page is asked for (``offset``, ``limit``). With ``total``, each row has ``total_count``, the
    number before paging, which costs a count.
    """
    c = [F.col(k) == v for k, v in (("node_type", node_type), ("content_type", content_type), ("dimension", dimension)) if v is not None]
    if has_property is not None:
        c.append(F.map_contains_key("properties", has_property))
    if property_equals is not None:
        c.append(F.col("properties")[property_equals[0]] == property_equals[1])
    n = g.nodes if (cond := every(c)) is None else g.nodes.where(cond)
    if edge_filter is not None:
        e = g.where_edges(edge_filter.column()).edges
        n = n.join(e.select(F.explode(F.array("source", "target")).alias("id")), "id", "left_semi")
    if total:
        n = n.withColumn("total_count", F.lit(n.count()).cast("long"))
    if offset or limit is not None:
        n = n.orderBy("id").offset(offset)
    return n if limit is None else n.limit(limit)


def traverse(g: Graph, origin: str, depth: int = 1, direction: str = "outgoing", relationship=None, min_weight=None, edge_filter=None) -> tuple[DataFrame, DataFrame]:
    """(levels, edges): levels has (id, level), the origin at 0; edges every matching edge met, once.

    Edges are filtered once, before the loop, which carries ids only. An origin that isn't a node gives nothing.
    """
    e = g.where_edges(edge_cond(relationship, min_weight, edge_filter)).edges
    adj = adjacency(saved(e) if depth > 1 else e, direction)
    seen = saved(g.nodes.where(F.col("id") == origin).select("id", F.lit(0).alias("level")).distinct())
    met, frontier = None, seen.select("id")
    for level in range(1, depth + 1):
        ids, n = _small(frontier)
        if not n:
            break
        hit = saved(adj.join(ids.withColumnRenamed("id", "here"), "here"))
        met = hit if met is None else met.unionByName(hit)
        new = hit.select(F.col("there").alias("id")).distinct().join(g.nodes.select("id"), "id", "left_semi").join(seen, "id", "left_anti")
        new = saved(new.select("id", F.lit(level).alias("level")))
        frontier, seen = new.select("id"), seen.union(new)
    cols = e.columns
    edges = e.limit(0) if met is None else met.select(cols).dropDuplicates(KEY)
    return seen, edges


def shortest_path(g: Graph, source: str, target: str, max_length: int = 10, direction: str = "outgoing", relationship=None, edge_filter=None) -> list[dict] | None:
    """Nodes of a shortest path with the edge that leads to each, or None. Of several predecessors, the edge with the
    least (seq, source, target) wins."""
    spark = g.nodes.sparkSession
    if g.nodes.where(F.col("id").isin(source, target)).select("id").distinct().count() < len({source, target}):
        return None
    if source == target:
        return [{"id": source, "via": None}]
    e = g.where_edges(edge_cond(relationship, None, edge_filter)).edges
    adj = adjacency(saved(e.select("source", "target", "relationship", "seq")), direction)
    seen = saved(spark.createDataFrame([(source,)], "id string"))
    frontier, levels = seen, []
    for _ in range(max_length):
        ids, n = _small(frontier)
        if not n:
            return None
        order = F.struct("seq", "source", "target")
        new = adj.join(ids.withColumnRenamed("id", "here"), "here").groupBy(F.col("there").alias("id")).agg(F.min_by(F.struct("here", "relationship"), order).alias("p"))
        new = saved(new.join(seen, "id", "left_anti"))
        levels.append(new)
        if not new.where(F.col("id") == target).isEmpty():
            break
        frontier, seen = new.select("id"), seen.union(new.select("id"))
    else:
        return None
    out, at = [], target
    for level in reversed(levels):
        p = level.where(F.col("id") == at).first().p
        out.append({"id": at, "via": p.relationship})
        at = p.here
    return [{"id": source, "via": None}, *reversed(out)]


def steps(g: Graph, origin: str, hops: Sequence[tuple[str, str]], edge_filter: EdgeFilter | None = None) -> tuple[DataFrame, DataFrame]:
    """(levels, edges) of typed hops (direction, relationship): a level for each hop, revisits allowed, edges kept
    once for every hop that meets them. One lazy plan, no loop over data."""
    e = g.where_edges(edge_filter.column() if edge_filter else None).edges
    front = g.nodes.where(F.col("id") == origin).select("id").distinct()
    levels, edges = None, None
    for k, (direction, relationship) in enumerate(hops, 1):
        hit = adjacency(e.where(F.col("relationship") == relationship), direction).join(front.withColumnRenamed("id", "here"), "here").withColumn("step", F.lit(k))
        front = hit.select(F.col("there").alias("id")).distinct().join(g.nodes.select("id"), "id", "left_semi")
        level = front.select("id", F.lit(k).alias("level"))
        levels = level if levels is None else levels.union(level)
        hit = hit.drop("here", "there")
        edges = hit if edges is None else edges.unionByName(hit)
    return levels, edges


def evidence(g: Graph, concept: str, edge_filter: EdgeFilter | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes has (id, kind): marks that reference the concept, chains that contain those, fragments
    tagged with it."""
    a, ea = steps(g, concept, [("incoming", "references"), ("incoming", "contains")], edge_filter)
    b, eb = steps(g, concept, [("incoming", "tagged_with")], edge_filter)
    kinds = a.select("id", F.when(F.col("level") == 1, "mark").otherwise("chain").alias("kind")).union(b.select("id", F.lit("fragment")))
    return kinds, ea.unionByName(eb)


def explain(g: Graph, a: str, b: str, relationship: str | None = None) -> DataFrame:
    """Every edge between two nodes, either way: relationship, direction, raw_weight, contributions, corroboration,
    translated_from, and the texts of both ends (their property text, else label, if a string). Raises where an end is
    missing."""
    text = {r.id: r.t for r in g.nodes.where(F.col("id").isin(a, b)).select("id", F.coalesce(string_of("text"), string_of("label")).alias("t")).collect()}
    if missing := sorted({a, b} - text.keys()):
        raise KeyError(f"no such node: {missing[0]}")
    s, t = F.col("source"), F.col("target")
    e = g.where_edges(edge_cond(relationship)).edges.where(((s == a) & (t == b)) | ((s == b) & (t == a)))
    ends = [F.lit(text[x]).cast("string").alias(n) for x, n in ((a, "source_text"), (b, "target_text"))]
    forward = F.when(s == a, "forward").otherwise("reverse")
    return e.select("relationship", forward.alias("direction"), "raw_weight", "contributions", F.size("contributions").cast("long").alias("corroboration"), translated_from().alias("translated_from"), *ends)


def translated_from() -> Column:
    pre = F.concat(F.col("relationship"), F.lit(":"))
    keys = F.filter(F.map_keys("contributions"), lambda k: k.startswith(pre))
    return F.when(F.col("relationship").startswith("lens:"), F.array_sort(F.transform(keys, lambda k: F.substring(k, F.length(pre) + 1, F.length(k))))).otherwise(F.array().cast("array<string>"))


def shared_concepts(a: Graph, b: Graph) -> DataFrame:
    c = lambda g: g.nodes.where("node_type = 'concept'").select("id")
    return c(a).intersect(c(b))


def changes_since(events: DataFrame, cursor: int, adapter_id: str | None = None, event_types: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    c = every([F.col("sequence") > cursor, None if adapter_id is None else F.col("adapter_id") == adapter_id, F.col("event_type").isin(*event_types) if event_types else None])
    out = events.where(c).orderBy("sequence")
    return out if limit is None else out.limit(limit)


def latest_sequence(events: DataFrame, changes: DataFrame, cursor: int) -> int:
    """Where to poll from next: the last change returned, else the end of the log."""
    last = changes.agg(F.max("sequence")).first()[0]
    return last if last is not None else max(cursor, events.agg(F.max("sequence")).first()[0] or 0)


def cross_dimensional() -> Column:
    return F.col("source_dimension") != F.col("target_dimension")


# -- query-time weights and ranking ------------------------------------------------------------------------------------

def per_source():
    return W.partitionBy("source")



def outgoing_divisive(edges: DataFrame) -> DataFrame:
    total = F.sum("raw_weight").over(per_source())
    return edges.withColumn("normalized_weight", F.when(total == 0, F.lit(0.0)).otherwise(F.col("raw_weight") / F.nullif(total, F.lit(0.0))))


#: Normalisations that need no edges but those of the same source.
BY_SOURCE = {outgoing_divisive}


def softmax(edges: DataFrame) -> DataFrame:
    e = edges.withColumn("_x", F.exp(F.col("raw_weight") - F.max("raw_weight").over(per_source())))
    return e.withColumn("normalized_weight", F.col("_x") / F.sum("_x").over(per_source())).drop("_x")


BY_SOURCE.add(softmax)


def rank(levels: DataFrame, edges: DataFrame, by: str = "raw_weight", normalize: Callable[[DataFrame], DataFrame] | None = None, all_edges: DataFrame | None = None) -> DataFrame:
    """(id, level, score, pos): within each level by descending score: the greatest value of an edge at the node, at
    least 0. ``by``: raw_weight, corroboration or normalized (by ``normalize`` over ``all_edges``; of parallel edges the
    last counts)."""
    if by == "normalized":
        if all_edges is not None and normalize in BY_SOURCE:
            all_edges = all_edges.join(_small(saved(edges.select("source").distinct()))[0], "source", "left_semi").select("source", "target", "relationship", "seq", "raw_weight")
        n = normalize(all_edges if all_edges is not None else edges).groupBy("source", "target").agg(F.max_by("normalized_weight", F.struct("seq", "relationship")).alias("value"))
        e = edges.select("source", "target").distinct().join(n, ["source", "target"])
    else:
        e = edges.select("source", "target", (F.col("raw_weight") if by == "raw_weight" else F.size("contributions").cast("double")).alias("value"))
    best = e.select(F.explode(F.array("source", "target")).alias("id"), "value").groupBy("id").agg(F.greatest(F.max("value"), F.lit(0.0)).alias("score"))
    out = levels.join(best, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.withColumn("pos", F.row_number().over(W.partitionBy("level").orderBy(F.desc("score"), "id")))


# -- provenance views --------------------------------------------------------------------------------------------------

def _prov(g: Graph, kind: str) -> DataFrame:
    return g.nodes.where((F.col("node_type") == kind) & (F.col("dimension") == "provenance"))


def tags_of() -> Column:
    return F.from_json(F.coalesce(F.col("properties")["tags"], F.lit("[]")), "array<string>")


def list_chains(g: Graph, status: str | None = None) -> DataFrame:
    if status not in (None, "active", "archived"):
        raise ValueError(f"status: {status}")
    c = _prov(g, "chain").select("id", text_of("name").alias("name"), F.coalesce(text_of("status"), F.lit("active")).alias("status"))
    return c if status is None else c.where(F.col("status") == status)


def list_marks(g: Graph, chain: str | None = None, file: str | None = None, mark_type: str | None = None, tag: str | None = None) -> DataFrame:
    """id, chain_id, file, line, annotation, tags, links (outgoing ``links_to``)."""
    m = _prov(g, "mark").select("id", text_of("chain_id").alias("chain_id"), text_of("file").alias("file"), text_of("line").cast("long").alias("line"), text_of("annotation").alias("annotation"), text_of("type").alias("type"), tags_of().alias("tags"))
    c = every([F.col(k) == v for k, v in (("chain_id", chain), ("file", file), ("type", mark_type)) if v is not None] + [None if tag is None else F.array_contains("tags", tag)])
    links = g.edges.where("relationship = 'links_to'").groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("target")).alias("links"))
    m = (m if c is None else m.where(c)).join(links, "id", "left")
    return m.withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


def get_chain(g: Graph, chain: str) -> tuple[DataFrame, DataFrame]:
    c = list_chains(g).where(F.col("id") == chain)
    if c.isEmpty():
        raise KeyError(chain)
    marks = g.edges.where((F.col("source") == chain) & (F.col("relationship") == "contains")).select(F.col("target").alias("id")).distinct()
    return c, list_marks(g).join(marks, "id", "left_semi")


def get_links(g: Graph, mark: str) -> tuple[DataFrame, DataFrame]:
    e = g.edges.where("relationship = 'links_to'")
    return e.where(F.col("source") == mark).select(F.col("target").alias("id")), e.where(F.col("target") == mark).select(F.col("source").alias("id"))


def list_tags(g: Graph) -> DataFrame:
    return _prov(g, "mark").select(F.explode(tags_of()).alias("tag")).distinct().orderBy("tag")


def export(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Frames of the JSON export for external analysis."""
    nodes = g.nodes.select("id", F.col("node_type").alias("type"), "dimension", F.coalesce(text_of("label"), F.lit("")).alias("label"))
    return nodes, g.edges.select("source", "target", "relationship", F.col("raw_weight").alias("weight"))


def write_export(g: Graph, path: str) -> dict[str, int]:
    """The export as JSON lines below ``path``: nodes, edges, and a line with their counts, which are returned."""
    nodes, edges = export(g)
    nodes.write.json(f"{path}/nodes")
    edges.write.json(f"{path}/edges")
    spark = g.nodes.sparkSession
    counts = {"node_count": spark.read.text(f"{path}/nodes").count(), "edge_count": spark.read.text(f"{path}/edges").count()}
    spark.createDataFrame([counts], "node_count bigint, edge_count bigint").coalesce(1).write.json(f"{path}/counts")
    return counts


# -- parts of a result -------------------------------------------------------------------------------------------------
def at_depth(levels: DataFrame, depth: int) -> DataFrame:
    return levels.where(F.col("level") == depth).select("id")


at_step = at_depth


def all_nodes(levels: DataFrame) -> DataFrame:
    """Everything reached, without the origin."""
    return levels.where("level > 0").select("id").distinct()


def max_depth(levels: DataFrame) -> int:
    return levels.agg(F.max("level")).first()[0] or 0
