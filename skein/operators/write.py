"""The write protocol: an emission (nodes, edges, property updates, removals) applied to a snapshot in fixed order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import KEY, Graph, edge_id, saved


@dataclass
class Emission:
    """``updates``: (id, properties). ``edge_removals``: (source, target, relationship). ``removals``: (id).
    ``annotations``: (id, confidence, method, source_location, detail) of emitted nodes, or of edges by ``edge_id``; they
    come back in the result's provenance and aren't kept."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    updates: DataFrame | None = None
    edge_removals: DataFrame | None = None
    removals: DataFrame | None = None
    annotations: DataFrame | None = None

    def merge(self, other: Emission) -> Emission:
        both = lambda a, b: a if b is None else b if a is None else a.unionByName(b)
        return Emission(*(both(getattr(self, k), getattr(other, k)) for k in self.__dataclass_fields__))

    def is_empty(self) -> bool:
        return all(x is None or x.isEmpty() for x in vars(self).values())


#: Ids of a row of the event log; an event with more has several parts with one sequence number.
EVENT_IDS = 10_000
EVENT = "sequence bigint, part int, context_id string, event_type string, node_ids array<string>, edge_ids array<string>, adapter_id string, reason string, created_at timestamp"
#: Kinds of change in the order of their events: event type, ids of nodes (else of edges), reason.
CHANGES = {
    "NodesAdded": ("NodesAdded", True, None),
    "EdgesAdded": ("EdgesAdded", False, None),
    "NodesRemoved": ("NodesRemoved", True, None),
    "EdgesRemoved": ("EdgesRemoved", False, "explicit"),
    "EdgesCascaded": ("EdgesRemoved", False, "cascade"),
    "WeightsChanged": ("WeightsChanged", False, None),
    "ContributionsRetracted": ("ContributionsRetracted", False, "retraction"),
    "EdgesPruned": ("EdgesRemoved", False, "retraction"),
}


@dataclass
class Result:
    """What an emission did. ``changed`` has the ids of nodes or keys of edges by kind of change; ``rejected`` the edges
    that weren't accepted, with a reason; ``provenance`` a row for each item that carried an annotation."""

    graph: Graph
    rejected: DataFrame | None = None
    changed: dict[str, DataFrame] = field(default_factory=dict)
    provenance: DataFrame | None = None
    sizes: dict[str, int] | None = None

    def settle(self) -> Result:
        """Write all changes as one table, so that they are worked out once, and count them."""
        if self.sizes is None and self.changed:
            all_ = None
            for k, d in self.changed.items():
                d = d.select(F.lit(k).alias("change"), *[(F.col(c) if c in d.columns else F.lit(None).cast("string")).alias(c) for c in ["id", *KEY]])
                all_ = d if all_ is None else all_.unionByName(d)
            t = saved(all_)
            found = {r.change: r.n for r in t.groupBy("change").agg(F.count("*").alias("n")).collect()}
            self.sizes = {k: found.get(k, 0) for k in self.changed}
            self.changed = {k: t.where(F.col("change") == k).select(["id"] if CHANGES[k][1] else KEY) for k in self.changed}
        return self

    def counts(self) -> dict[str, int]:
        self.settle()
        return (self.sizes or {}) | {"rejected": 0 if self.rejected is None else self.rejected.count()}

    def is_noop(self) -> bool:
        self.settle()
        return not any((self.sizes or {}).values())

    def is_fully_committed(self) -> bool:
        return self.rejected is None or self.rejected.isEmpty()

    def events(self, adapter: str, context: str = "", after: int = 0) -> DataFrame | None:
        """Rows of EVENT for the changes that aren't empty, numbered from ``after`` + 1 in the order of CHANGES."""
        self.settle()
        out, n = None, after
        for kind, (event, nodes, reason) in CHANGES.items():
            size = (self.sizes or {}).get(kind, 0)
            if not size:
                continue
            d, n = self.changed[kind], n + 1
            ids = d.select((F.col("id") if nodes else edge_id(context)).alias("id"))
            ids = ids.select("id", F.pmod(F.xxhash64("id"), F.lit(-(-size // EVENT_IDS))).cast("int").alias("part"))
            if not nodes:  # 32 bytes of a digest instead of 64 digits
                ids = ids.select(F.unhex("id").alias("id"), "part")
            e = ids.groupBy("part").agg(F.array_sort(F.collect_list("id")).alias("ids"))
            if not nodes:
                e = e.withColumn("ids", F.transform("ids", lambda x: F.lower(F.hex(x))))
            none = F.array().cast("array<string>")
            e = e.select(F.lit(n).cast("bigint").alias("sequence"), "part", F.lit(context).alias("context_id"), F.lit(event).alias("event_type"), (F.col("ids") if nodes else none).alias("node_ids"), (none if nodes else F.col("ids")).alias("edge_ids"), F.lit(adapter).alias("adapter_id"), F.lit(reason).cast("string").alias("reason"), F.current_timestamp().alias("created_at"))
            out = e if out is None else out.unionByName(e)
        return out


def last_wins(a: Column, b: Column) -> Column:
    """Map ``a`` overlaid with ``b``, without the session's duplicate-key policy."""
    keep = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(keep, b)


def last_rows(new: DataFrame, key: str = "id") -> DataFrame:
    """One row for each key: that with the greatest ``ord``; without one, any of equal ones and else the greatest."""
    rest = [c for c in new.columns if c not in (key, "ord")]
    text = F.to_json(F.struct(*rest))
    order = F.struct("ord", text) if "ord" in new.columns else F.struct(text)
    return new.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, "v.*")


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Full replacement by id; of several new rows of an id, that with the greatest ``ord`` (if any) wins."""
    new = last_rows(new)
    return nodes.join(new.select("id"), "id", "left_anti").unionByName(new.select(nodes.columns))


def check_ends(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): an edge is rejected alone if its source, then its target, is missing."""
    ids = nodes.select("id").distinct()
    e = edges.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    reason = F.when(F.col("_s").isNull(), "missing source").when(F.col("_t").isNull(), "missing target")
    e = e.withColumn("reason", reason).select(*edges.columns, "reason")
    return e.where("reason is null").drop("reason"), e.where("reason is not null")


def assign_contribution(edges: DataFrame, adapter: str) -> DataFrame:
    """Edges without contributions get their weight as the adapter's contribution; explicit maps stay."""
    if not adapter:
        return edges
    c = F.col("contributions")
    return edges.withColumn("contributions", F.when(c.isNull() | (F.size(c) <= 0), F.create_map(F.lit(adapter), F.col("raw_weight"))).otherwise(c))


def merge_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by the 5-part key: contributions and properties per slot, the latest value wins; without contributions the
    greater weight stays. In-batch duplicates are folded in order of ``seq`` first. Old edges keep their ``seq``."""
    fold = lambda c: F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.map_entries(c).alias("m")))), lambda x: F.map_from_entries(F.coalesce(x.m, F.map_entries(F.create_map().cast(f"map<string,{'double' if c == 'contributions' else 'string'}>"))))), F.create_map().cast(f"map<string,{'double' if c == 'contributions' else 'string'}>"), last_wins)
    n = new.groupBy(*KEY).agg(fold("contributions").alias("nc"), fold("properties").alias("np"), F.max("raw_weight").alias("nw"), F.min("seq").alias("ns"))
    j = edges.join(n, KEY, "full_outer")
    have = lambda c, kind: F.coalesce(c, F.create_map().cast(f"map<string,{kind}>"))
    w = F.when(F.size(have("nc", "double")) > 0, F.coalesce("raw_weight", "nw")).otherwise(F.greatest(F.coalesce("raw_weight", "nw"), F.coalesce("nw", "raw_weight")))
    out = j.select(*KEY, last_wins(have("contributions", "double"), have("nc", "double")).alias("contributions"), w.alias("raw_weight"), last_wins(have("properties", "string"), have("np", "string")).alias("properties"), F.coalesce("seq", "ns").alias("seq"))
    variants = F.count("*").over(W.partitionBy("source", "target", "relationship"))
    out = out.withColumn("_v", variants)
    cross = F.create_map(F.lit("_cross_dim_count"), F.col("_v").cast("string"))
    return out.withColumn("properties", F.when(F.col("_v") > 1, last_wins(F.col("properties"), cross)).otherwise(F.col("properties"))).drop("_v")


#: Contributors whose maxima are put into the plan; more are joined.
MAX_CONTRIBUTORS = 1_000


def recompute_weights(edges: DataFrame) -> DataFrame:
    """raw_weight = sum of each contribution over the greatest absolute one of its contributor in the graph.

    One pass over the edges finds the maxima, a row for each contributor. Up to ``MAX_CONTRIBUTORS`` of them become
    literals of a second pass without a join; more are joined to the single contributions.
    """
    each = edges.select(F.explode("contributions").alias("k", "v"))
    m = each.groupBy("k").agg(F.max(F.abs("v")).alias("m"))
    few = m.limit(MAX_CONTRIBUTORS + 1).collect()
    if not few:
        return edges
    if len(few) <= MAX_CONTRIBUTORS:
        top = F.create_map(*[x for r in few for x in (F.lit(r.k), F.lit(float(r.m)))])
        part = F.transform(F.map_entries("contributions"), lambda x: F.when(top[x.key] == 0, F.lit(0.0)).otherwise(x.value / top[x.key]))
        total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
        return edges.withColumn("raw_weight", F.when(F.size("contributions") > 0, total).otherwise(F.col("raw_weight")))
    share = F.when(F.col("m") == 0, F.lit(0.0)).otherwise(F.col("v") / F.col("m"))
    sums = edges.select(*KEY, F.explode("contributions").alias("k", "v")).join(m, "k").groupBy(*KEY).agg(F.sum(share).alias("_w"))
    return edges.join(sums, KEY, "left").withColumn("raw_weight", F.coalesce("_w", "raw_weight")).select(edges.columns)


def fold_updates(updates: DataFrame) -> DataFrame:
    """(id, properties): of several updates of a node, each key has the value of the row with the greatest ``ord``; on a
    tie, or without one, the greatest value."""
    order = F.struct("ord", "v") if "ord" in updates.columns else F.struct("v")
    u = updates.select("id", F.explode("properties").alias("k", "v"), *(["ord"] if "ord" in updates.columns else []))
    one = u.groupBy("id", "k").agg(F.max_by("v", order).alias("v"))
    return one.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))


def update_properties(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Per-key overlay on existing nodes; updates of missing nodes are skipped, those of one node folded first."""
    j = nodes.join(fold_updates(updates).withColumnRenamed("properties", "_p"), "id", "left")
    return j.withColumn("properties", F.when(F.col("_p").isNull(), F.col("properties")).otherwise(last_wins(F.coalesce("properties", F.create_map().cast("map<string,string>")), F.col("_p")))).drop("_p").select(nodes.columns)


def remove_edges(edges: DataFrame, removals: DataFrame) -> DataFrame:
    """Without all edges of the (source, target, relationship), in any dimensions."""
    return edges.join(removals, ["source", "target", "relationship"], "left_anti").select(edges.columns)


def remove_nodes(g: Graph, removals: DataFrame) -> Graph:
    """Without the nodes and the edges at them (cascade)."""
    r = removals.select("id").distinct()
    e = g.edges.join(r.withColumnRenamed("id", "source"), "source", "left_anti").join(r.withColumnRenamed("id", "target"), "target", "left_anti")
    return Graph(g.nodes.join(r, "id", "left_anti").select(g.nodes.columns), e.select(g.edges.columns))


def weights_changed(edges: DataFrame, new: DataFrame, adapter: str) -> DataFrame:
    """Keys of new edges whose key existed with another contribution of the adapter than the new weight."""
    old = edges.select(*KEY, F.col("contributions")[adapter].alias("_o"))
    return new.join(old, KEY).where(~F.col("_o").eqNullSafe(F.col("raw_weight"))).select(*KEY)


def retract(g: Graph, adapter: str) -> tuple[Graph, DataFrame]:
    """(graph, counts): the adapter's slot leaves every edge, edges that become empty go, weights are recomputed.
    counts: (affected, pruned)."""
    e = g.edges.withColumn("_had", F.map_contains_key("contributions", F.lit(adapter))).withColumn("contributions", F.map_filter("contributions", lambda k, _: k != adapter))
    gone = F.col("_had") & (F.size("contributions") == 0)
    counts = e.agg(F.count(F.when(F.col("_had"), 1)).alias("affected"), F.count(F.when(gone, 1)).alias("pruned"))
    return Graph(g.nodes, recompute_weights(e.where(~gone).drop("_had"))), counts


def retracted(g: Graph, adapter: str) -> Result:
    """``retract`` with what changed, for the event log."""
    had = g.edges.where(F.map_contains_key("contributions", F.lit(adapter)))
    out = Result(retract(g, adapter)[0])
    out.changed = {"ContributionsRetracted": had.select(*KEY), "EdgesPruned": had.where(F.size("contributions") == 1).select(*KEY)}
    return out


def apply(g: Graph, e: Emission, adapter: str) -> Result:
    """Upsert nodes, merge checked edges, recompute weights if any came, update properties, remove edges, then nodes.

    Weights aren't recomputed after removals. A missing part of the emission changes nothing. Updated nodes are reported
    with the added ones, edges that go with their nodes as cascaded.
    """
    nodes, edges, out = g.nodes, g.edges, Result(g)
    added = None
    if e.annotations is not None:
        out.provenance = e.annotations.withColumns({"adapter_id": F.lit(adapter), "timestamp": F.current_timestamp()})
    if e.nodes is not None:
        nodes = upsert_nodes(nodes, e.nodes)
        added = e.nodes.select("id").distinct()
    if e.edges is not None:
        ok, out.rejected = check_ends(assign_contribution(e.edges, adapter), nodes)
        out.changed["EdgesAdded"] = ok.select(*KEY).distinct()
        out.changed["WeightsChanged"] = weights_changed(edges, ok.withColumn("raw_weight", F.coalesce(F.col("contributions")[adapter], "raw_weight")), adapter).distinct()
        merged = merge_edges(edges, ok)
        edges = merged if ok.isEmpty() else recompute_weights(merged)
    if e.updates is not None:
        updated = e.updates.select("id").distinct().join(nodes.select("id"), "id", "left_semi")
        added = updated if added is None else added.union(updated).distinct()
        nodes = update_properties(nodes, e.updates)
    if added is not None:
        out.changed["NodesAdded"] = added
    g = Graph(nodes, edges)
    if e.edge_removals is not None:
        out.changed["EdgesRemoved"] = g.edges.join(e.edge_removals, ["source", "target", "relationship"], "left_semi").select(*KEY)
        g = Graph(g.nodes, remove_edges(g.edges, e.edge_removals))
    if e.removals is not None:
        gone = g.nodes.join(e.removals, "id", "left_semi").select("id")
        out.changed["NodesRemoved"] = gone
        kept = remove_nodes(g, gone)
        out.changed["EdgesCascaded"] = g.edges.select(*KEY).join(kept.edges.select(*KEY), KEY, "left_anti")
        g = kept
    out.graph = g
    return out
