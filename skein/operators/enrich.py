"""Derived-edge operators and the loop that runs them to a fixed point.

An enrichment takes a snapshot and returns edges to add (columns of EDGE). Existing (source, target, relationship) are
guarded against, so a second run adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Graph, bucketed, discard, saved
from . import blocks, write

RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"


def _edges(pairs: DataFrame, relationship: str | Column, contributor: str) -> DataFrame:
    """Pairs (source, target, w) as edges of dimension semantic."""
    s = F.lit("semantic")
    return pairs.select("source", "target", F.lit(relationship).alias("relationship"), s.alias("source_dimension"), s.alias("target_dimension"), F.create_map(F.lit(contributor), F.col("w")).alias("contributions"), F.col("w").alias("raw_weight"), F.create_map().cast("map<string,string>").alias("properties"), F.xxhash64("source", "target").alias("seq"))


def _new(pairs: DataFrame, g: Graph, relationship: str) -> DataFrame:
    """Pairs without such an edge. Where there is none at all, pairs aren't shuffled to find that out."""
    there = g.edges.where(F.col("relationship") == relationship).select("source", "target")
    return pairs if there.isEmpty() else pairs.join(there, ["source", "target"], "left_anti")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("source", "target", "w").union(pairs.select("target", "source", "w"))


def cooccurrence(g: Graph, relationship: str = "tagged_with", out: str = "may_be_related") -> DataFrame:
    """Targets of common sources, both directions, scored by shared sources over the greatest such number.

    Pairs are counted on (source, target) pairs that are distinct; the self-join's hot sources are split by AQE.
    """
    t = g.edges.where(F.col("relationship") == relationship).select("source", "target").distinct()
    p = t.select(F.col("source").alias("k"), F.col("target").alias("source")).join(t.select(F.col("source").alias("k"), "target"), "k").where("source < target")
    n = saved(p.groupBy("source", "target").agg(F.count("*").alias("n")))
    top = n.agg(F.max("n")).first()[0]
    scored = n.withColumn("w", F.col("n") / F.lit(float(top or 1)))
    return _edges(_new(_both(scored), g, out), out, f"co_occurrence:{relationship}:{out}")


def discovery_gap(g: Graph, trigger: str = "similar_to", out: str = "discovery_gap") -> DataFrame:
    """Trigger edges between nodes without other evidence (an edge either way of neither trigger nor output), in both
    directions, without those that are there. The edges of two nodes are gathered once."""
    s, t, r = F.col("source"), F.col("target"), F.col("relationship")
    ahead, is_out = s <= t, r == out
    w = F.when(r == trigger, F.struct(F.col("seq"), F.col("raw_weight").alias("w")))
    e = g.edges.select(F.least(s, t).alias("a"), F.greatest(s, t).alias("b"), F.when(ahead, w).alias("wf"), F.when(~ahead, w).alias("wb"), (is_out & ahead).alias("of"), (is_out & ~ahead).alias("ob"), (~is_out & (r != trigger)).alias("known"))
    p = e.groupBy("a", "b").agg(F.max("wf").alias("wf"), F.max("wb").alias("wb"), F.max("of").alias("of"), F.max("ob").alias("ob"), F.max("known").alias("known")).where("not known")
    p = p.withColumn("w", F.greatest(F.when(~F.col("of"), F.col("wf")), F.when(~F.col("ob"), F.col("wb")))).where("w is not null")
    both = F.array_compact(F.array(F.when(~F.col("of"), F.struct(F.col("a").alias("source"), F.col("b").alias("target"))), F.when(~F.col("ob") & (F.col("a") != F.col("b")), F.struct(F.col("b").alias("source"), F.col("a").alias("target")))))
    return _edges(p.select(F.explode(both).alias("e"), "w.w").select("e.*", "w"), out, f"discovery_gap:{trigger}:{out}")


def epoch_ms(value: Column) -> Column:
    """Milliseconds of a JSON-encoded property: an integer as it is, a float truncated, a string only in RFC 3339."""
    s = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    stamp = F.when(value.startswith('"') & s.rlike(RFC3339), F.unix_millis(F.try_to_timestamp(s)))
    return F.coalesce(stamp, F.when(value.rlike(r"^-?\d+$"), value.try_cast("bigint")), F.when(value.rlike(r"^-?[\d.]+([eE][+-]?\d+)?$"), value.try_cast("double").try_cast("bigint")))


def temporal_proximity(g: Graph, prop: str = "created_at", threshold_ms: int = 86_400_000, out: str = "temporal_proximity", node_types: Sequence[str] | None = ("fragment",)) -> DataFrame:
    """Nodes whose times differ by at most the threshold, both directions, weight 1: an interval join by buckets, of
    which the later node is put in its own and the one before, so each pair meets once."""
    n = g.nodes if node_types is None else g.nodes.where(F.col("node_type").isin(*node_types))
    n = n.select("id", epoch_ms(F.col("properties")[prop]).alias("ms")).where("ms is not null")
    b = F.floor(F.col("ms") / F.lit(max(threshold_ms, 1)))
    first = n.select(F.col("id").alias("source"), F.col("ms").alias("m1"), b.alias("b"))
    later = n.select(F.col("id").alias("target"), F.col("ms").alias("m2"), F.explode(F.array(b, b - 1)).alias("b"))
    after = (F.col("m1") < F.col("m2")) | ((F.col("m1") == F.col("m2")) & (F.col("source") < F.col("target")))
    p = first.join(later, "b").where(after & (F.col("m2") - F.col("m1") <= threshold_ms) & (F.col("source") != F.col("target")))
    name = f"temporal:{prop}:{threshold_ms}:{out}" + (":" + "+".join(node_types) if node_types else "")
    return _edges(_new(_both(p.withColumn("w", F.lit(1.0))), g, out), out, name)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def embedding_similarity(g: Graph, vectors: DataFrame, model: str, threshold: float = 0.7, out: str = "similar_to") -> DataFrame:
    """Pairs of nodes with vectors (id, embedding) that are similar enough, both directions, weighted by similarity."""
    v = vectors.join(g.nodes.select("id"), "id", "left_semi")
    return _edges(_new(_both(blocks.pairs(v, threshold)), g, out), out, f"embedding:{model}")


@dataclass(frozen=True)
class Translation:
    sources: tuple[str, ...]
    to: str
    min_weight: float = 0.0
    min_corroboration: int = 1


def lens(g: Graph, consumer: str, rules: Sequence[Translation]) -> DataFrame:
    """Edges translated into a consumer's vocabulary, ``lens:consumer:to``, a contribution for each source relationship.

    Rules with the same ``to`` merge; the last one's min_corroboration counts.
    """
    spark = g.nodes.sparkSession
    need = {r.to: r.min_corroboration for r in rules}
    rows = [(r.to, s, float(r.min_weight), k) for k, r in enumerate(rules) for s in r.sources]
    table = F.broadcast(spark.createDataFrame(rows, "to string, relationship string, least double, k int"))
    rel = F.concat(F.lit(f"lens:{consumer}:"), "to")
    e = g.edges.join(table, "relationship").where("raw_weight >= least").select("source", "target", rel.alias("relationship"), F.concat(rel, F.lit(":"), "relationship").alias("key"), "raw_weight", "seq", "k", "to")
    e = e.join(g.edges.select("source", "target", "relationship"), ["source", "target", "relationship"], "left_anti")
    one = e.groupBy("source", "target", "relationship", "to", "key").agg(F.max_by("raw_weight", F.struct("k", "seq")).alias("w"))
    m = one.groupBy("source", "target", "relationship", "to").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "w")))).alias("contributions"), F.greatest(F.max("w"), F.lit(0.0)).alias("raw_weight"))
    least = F.element_at(F.create_map(*[F.lit(x) for kv in need.items() for x in kv]), F.col("to"))
    m = m.where(F.size("contributions") >= least)
    s = F.lit("semantic")
    return m.select("source", "target", "relationship", s.alias("source_dimension"), s.alias("target_dimension"), "contributions", "raw_weight", F.create_map().cast("map<string,string>").alias("properties"), F.xxhash64("source", "target").alias("seq"))


@dataclass(frozen=True)
class Enrichment:
    """A rule with an id: edges to add to a snapshot. It runs if an event of ``triggers`` happened in the round before
    (any event, if empty)."""

    id: str
    run: Callable[[Graph], DataFrame | None]
    triggers: tuple[str, ...] = ()


def co_occurrence(source: str = "tagged_with", out: str = "may_be_related") -> Enrichment:
    return Enrichment(f"co_occurrence:{source}:{out}", lambda g: cooccurrence(g, source, out), ("NodesAdded", "EdgesAdded"))


def gap(trigger: str = "similar_to", out: str = "discovery_gap") -> Enrichment:
    return Enrichment(f"discovery_gap:{trigger}:{out}", lambda g: discovery_gap(g, trigger, out), ("EdgesAdded",))


def temporal(prop: str = "created_at", threshold_ms: int = 86_400_000, out: str = "temporal_proximity", node_types: Sequence[str] | None = None) -> Enrichment:
    name = f"temporal:{prop}:{threshold_ms}:{out}" + (":" + "+".join(node_types) if node_types else "")
    return Enrichment(name, lambda g: temporal_proximity(g, prop, threshold_ms, out, node_types), ("NodesAdded",))


def default_enrichments() -> list[Enrichment]:
    """Those of the default pipeline, in its order."""
    return [co_occurrence(), gap(), temporal(node_types=("fragment",))]


def run_rounds(g: Graph, enrichments: Sequence[Enrichment], events: set[str] | None = None, max_rounds: int = 10) -> tuple[Graph, list[tuple[str, write.Result]]]:
    """(graph, commits): rounds until nothing is added. In a round, the enrichments that the events of the round before
    trigger (``events`` at first, None: all) see the same snapshot, then commit in order. Enrichments are taken once by
    id. Each commit's edges are tables, so later rounds don't compute them again."""
    unique = list({e.id: e for e in reversed(enrichments)}.values())[::-1]
    commits: list[tuple[str, write.Result]] = []
    for _ in range(max_rounds):
        due = [e for e in unique if events is None or not e.triggers or events & set(e.triggers)]
        added = [(e.id, t) for e in due if (x := e.run(g)) is not None and not (t := saved(x)).isEmpty()]
        if not added:
            break
        events = {"EdgesAdded"}
        for name, t in added:
            done = write.apply(g, write.Emission(edges=t), name)
            if done.settle().sizes["WeightsChanged"]:
                events.add("WeightsChanged")
            g = Graph(g.nodes, saved(done.graph.edges))
            commits.append((name, done))
    return g, commits


def run_loop(g: Graph, enrichments: dict[str, Callable[[Graph], DataFrame]], max_rounds: int = 10) -> tuple[Graph, int]:
    """Rounds until nothing is added: all enrichments see the same snapshot, then commit in order. Returns the rounds."""
    for k in range(max_rounds):
        added = [(name, e) for name, f in enrichments.items() if not (e := saved(f(g))).isEmpty()]
        if not added:
            return g, k
        for name, e in added:
            g = write.apply(g, write.Emission(edges=e), name).graph
        g = Graph(g.nodes, saved(g.edges))
    return g, max_rounds


def pagerank(g: Graph, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, pagerank): weights ignored, dangling mass spread evenly.

    Ranks are sums of what one unit for each node becomes after 0, 1, ... steps along the edges (``y``), since all that
    a round adds besides is the same for every node. What to multiply them by follows from their totals, so the rounds
    carry only nodes that so many steps reach, and end early where there are none (a graph without cycles)."""
    nodes = saved(g.nodes.select("id").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("pagerank", F.lit(0.0))
    size = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = g.edges.select("source", "target").repartition(size, "source").distinct()
    out = bucketed(e.withColumn("deg", F.count("*").over(W.partitionBy("source"))), "source")
    ys, totals = [nodes.select("id", F.lit(1.0).alias("y"))], []
    for _ in range(rounds):
        got = out.join(ys[-1].withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("y") / F.col("deg")).alias("y"))
        y = saved(got.join(nodes.withColumn("known", F.lit(True)), "id", "left"))
        totals.append(y.agg(F.coalesce(F.sum("y"), F.lit(0.0))).first()[0])
        ys.append(y.where("known").drop("known"))
        if not totals[-1]:
            break
    c = [1 / n]
    for _ in range(rounds):
        mass = 1 - sum(a * b for a, b in zip(c, totals))
        c = [(1 - damping) / n + damping * mass / n, *(damping * x for x in c)]
    terms = None
    for y, k in zip(ys, c):
        term = y.select("id", (F.col("y") * k).alias("y"))
        terms = term if terms is None else terms.union(term)
    r = saved(terms.groupBy("id").agg(F.sum("y").alias("pagerank")))
    discard(out, *ys)
    return r


def components(g: Graph) -> DataFrame:
    """(id, component): the least id of the weakly connected component.

    In a round each vertex points to its least neighbour if that is less, pointers are followed to their ends, and the
    edges between ends are those of the next round. The least id of a component stays to the last. Edges are held by
    their greater end, so pointers are found where they are. Edges at ends that aren't nodes don't count; that a lesser
    end isn't one shows when the edges meet the pointers, and then the first round begins again without them."""
    size = int(g.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = bucketed(g.nodes.select(F.col("id").alias("v")).distinct(), "v")
    s, t = F.col("source"), F.col("target")
    e = g.edges.where(s != t).select(F.greatest(s, t).alias("v"), F.least(s, t).alias("o"))
    e = bucketed(e.join(ids, "v", "left_semi"), "v")
    ends, node = [], ids.select(F.col("v").alias("o"), F.lit(True).alias("node"))
    while not e.isEmpty():
        p = bucketed(e.groupBy("v").agg(F.min("o").alias("m")), "v", True)
        step = p.select(F.col("v").alias("m"), F.col("m").alias("n"))
        far = [saved(p.join(step, "m").select("v", F.col("n").alias("m"), F.lit(True).alias("moved")))]
        while not far[-1].where("moved").isEmpty():
            o = far[-1]
            x = o.where("moved").join(o.select(F.col("v").alias("m"), F.col("m").alias("k")), "m", "left").join(step, "m", "left")
            x = x.select("v", F.coalesce("k", "n", "m").alias("m"), F.coalesce("k", "n").isNotNull().alias("moved"))
            far.append(saved(o.where("not moved").union(x)))
        root = bucketed(p.join(far[-1].select("v", F.col("m").alias("n")), "v", "left").select("v", F.coalesce("n", "m").alias("root")), "v", True)
        r = lambda c: root.select(F.col("v").alias(c), F.col("root").alias(f"{c}r"))
        x = e.join(r("v"), "v", "left").select(F.coalesce("vr", "v").alias("v"), "o").join(r("o"), "o", "left")
        x = x.withColumn("node", F.lit(True)) if ends else x.join(node, "o", "left")
        x = x.select("v", F.coalesce("or", "o").alias("o"), "node").where("v <> o or node is null").select(F.greatest("v", "o").alias("v"), F.least("v", "o").alias("o"), "node")
        x = bucketed(x.repartition(size, "v").distinct(), "v", True)
        discard(p, *far)
        if not ends and not x.where("node is null").isEmpty():  # pointers were to what isn't a node
            again = bucketed(e.join(node, "o", "left_semi"), "v")
            discard(x, root, e)
            e = again
            continue
        discard(e)
        e = x.select("v", "o")
        ends.append(root)
    lab = ids.select("v", F.col("v").alias("label"))
    for root in ends:
        lab = lab.join(root.select(F.col("v").alias("label"), "root"), "label", "left").select("v", F.coalesce("root", "label").alias("label"))
    lab = saved(lab.toDF("id", "component"))
    discard(ids, e, *ends)
    return lab
