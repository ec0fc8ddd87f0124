"""Properties that hold on any graph, on random ones, against plain Python."""

import random

import pytest

from skein.model import EDGE, KEY, NODE, Graph, edge_id
from skein.operators import enrich, read, write


def random_graph(spark, seed):
    r = random.Random(seed)
    ids = [f"n{i}" for i in range(14)]
    keys = {(r.choice(ids), r.choice(ids), r.choice("ab")) for _ in range(26)}
    rows = [(s, t, k, "d", "d", {c: r.uniform(-3, 5) for c in r.sample("xyz", r.randint(1, 3))}, 0.0, {}, i) for i, (s, t, k) in enumerate(sorted(keys))]
    nodes = spark.createDataFrame([(i, "n", "document", "d", {}) for i in ids], NODE)
    return Graph(nodes, spark.createDataFrame(rows, EDGE)), rows


def levels_of(rows, origin, depth, way):
    level, front = {origin: 0}, {origin}
    for k in range(1, depth + 1):
        front = {b for r in rows for a, b in ([(r[0], r[1])] if way != "incoming" else []) + ([(r[1], r[0])] if way != "outgoing" else []) if a in front} - level.keys()
        level |= dict.fromkeys(front, k)
    return level


@pytest.mark.parametrize("seed, way", [(1, "outgoing"), (2, "incoming"), (3, "both")])
def test_traverse_and_path_are_breadth_first(spark, seed, way):
    g, rows = random_graph(spark, seed)
    want = levels_of(rows, "n0", 3, way)
    levels, edges = read.traverse(g, "n0", 3, way)
    assert {r.id: r.level for r in levels.collect()} == want
    inner = {i for i, k in want.items() if k < 3}
    met = {r[:3] for r in rows if (way != "incoming" and r[0] in inner) or (way != "outgoing" and r[1] in inner)}
    assert {tuple(r) for r in edges.select("source", "target", "relationship").collect()} == met
    far = max(want, key=lambda i: (want[i], i))
    path = read.shortest_path(g, "n0", far, 3, way)
    assert len(path) - 1 == want[far] and path[0]["id"] == "n0" and path[-1]["id"] == far


def test_weights_do_not_change_with_a_contributors_scale(spark):
    from pyspark.sql import functions as F

    g, rows = random_graph(spark, 4)
    scaled = g.edges.withColumn("contributions", F.transform_values("contributions", lambda k, v: F.when(k == "x", v * 7).otherwise(v)))
    a, b = ({tuple(r[:3]): r.w for r in write.recompute_weights(e).select("source", "target", "relationship", F.round("raw_weight", 9).alias("w")).collect()} for e in (g.edges, scaled))
    assert a == b
    top = {c: max(abs(r[5][c]) for r in rows if c in r[5]) for c in "xyz"}
    assert a == {r[:3]: pytest.approx(sum(v / top[c] for c, v in r[5].items()), abs=1e-8) for r in rows}


def test_retraction_undoes_an_emission(spark):
    from pyspark.sql import functions as F

    g, _ = random_graph(spark, 5)
    more, _ = random_graph(spark, 6)
    more = more.edges.withColumn("contributions", F.create_map(F.lit("new"), F.lit(2.0)))
    after = write.apply(g, write.Emission(edges=more), "new").graph
    back, _ = write.retract(after, "new")
    rows = lambda e: {tuple(r[:5]): (r.contributions, round(r.raw_weight, 9)) for r in e.select(*KEY, "contributions", "raw_weight").collect()}
    assert rows(back.edges) == rows(write.recompute_weights(g.edges))


def test_enrichments_add_nothing_the_second_time(spark):
    g, _ = random_graph(spark, 7)
    rules = [enrich.co_occurrence("a", "related"), enrich.gap("related", "gap")]
    once, commits = enrich.run_rounds(g, rules)
    assert commits and enrich.run_rounds(once, rules)[1] == []
    e = once.edges.where("relationship = 'related'")
    both = {(r.source, r.target): r.contributions for r in e.collect()}
    assert all(both[t, s] == c for (s, t), c in both.items())
    assert once.edges.select(edge_id().alias("i")).distinct().count() == once.edges.count()
