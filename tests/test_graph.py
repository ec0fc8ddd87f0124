import uuid

import pytest
from pyspark.sql import functions as F

from skein.model import EDGE, NODE, Graph, uuid5
from skein.operators import enrich, read, write
from skein.operators.filters import EdgeFilter


def graph(spark, edges, extra=()):
    ids = sorted({x for e in edges for x in e[:2]} | set(extra))
    n = spark.createDataFrame([(i, "concept" if i.startswith("c") else "n", "concept", "semantic", {"label": f'"{i}"'}) for i in ids], NODE)
    rows = [(a, b, r, "semantic", "semantic", c, float(w), {}, k) for k, (a, b, r, w, c) in enumerate(edges)]
    return Graph(n, spark.createDataFrame(rows, EDGE))


def ids(df):
    return {tuple(r) for r in df.collect()}


def test_max_abs_ratios(spark):
    g = graph(spark, [("a", "b", "s", 1, {"e": 0.8165}), ("a", "c", "s", 1, {"e": 0.7856}), ("a", "d", "s", 1, {"e": 0.7794})])
    w = sorted(r.raw_weight for r in write.recompute_weights(g.edges).collect())
    assert w == pytest.approx([0.7794 / 0.8165, 0.7856 / 0.8165, 1.0], abs=1e-4)


def test_normalized_rank(spark):
    g = graph(spark, [("a", "b", "r", 3, {}), ("a", "c", "r", 1, {}), ("x", "y", "r", 2, {})])
    n = {(r.source, r.target): r.normalized_weight for r in read.outgoing_divisive(g.edges).collect()}
    assert n == {("a", "b"): 0.75, ("a", "c"): 0.25, ("x", "y"): 1.0}


def test_traverse_levels_and_path(spark):
    g = graph(spark, [("a", "b", "calls", 1, {}), ("b", "c", "calls", 1, {}), ("c", "d", "calls", 1, {}), ("b", "e", "uses", 1, {}), ("a", "b", "uses", 1, {})])
    levels, edges = read.traverse(g, "a", 2)
    assert ids(levels.select("id", "level")) == {("a", 0), ("b", 1), ("c", 2), ("e", 2)}
    assert edges.count() == 4
    assert [x["id"] for x in read.shortest_path(g, "a", "d")] == ["a", "b", "c", "d"]
    assert read.shortest_path(g, "a", "d", 2) is None and read.shortest_path(g, "d", "a") is None
    assert read.shortest_path(g, "a", "a") == [{"id": "a", "via": None}] and read.shortest_path(g, "a", "zz") is None
    assert read.traverse(g, "zz")[0].isEmpty()


def test_filter_edges_cases(spark):
    g = graph(spark, [("a", "b", "r", 1, {"p": 1.0, "q": 1.0}), ("c", "d", "r", 1, {"p": 1.0})])
    find = lambda **k: {r.id for r in read.find(g, edge_filter=EdgeFilter(**k)).collect()}
    assert find(min_corroboration=2) == {"a", "b"} and find(contributors=[]) == set() and len(find(prefix="")) == 4


def test_apply_rejects_and_merges(spark):
    g = graph(spark, [("a", "b", "r", 1, {"p": 2.0})])
    new = graph(spark, [("a", "b", "r", 4, {}), ("a", "z", "r", 1, {}), ("z", "a", "r", 1, {})])
    res = write.apply(g, write.Emission(edges=new.edges), "q")
    assert {(r.source, r.reason) for r in res.rejected.collect()} == {("a", "missing target"), ("z", "missing source")}
    (e,) = res.graph.edges.collect()
    assert e.contributions == {"p": 2.0, "q": 4.0} and e.raw_weight == 2.0
    back, counts = write.retract(res.graph, "q")
    assert tuple(counts.first()) == (1, 0) and back.edges.first().contributions == {"p": 2.0}


def test_lens_and_idempotence(spark):
    g = graph(spark, [("ca", "cb", "may_be_related", 0.4, {}), ("ca", "cb", "similar_to", 0.7, {})])
    rule = [enrich.Translation(("may_be_related", "similar_to"), "theme")]
    (e,) = enrich.lens(g, "x", rule).collect()
    assert e.raw_weight == 0.7 and len(e.contributions) == 2
    after, rounds = enrich.run_loop(g, {"lens:x": lambda g: enrich.lens(g, "x", rule)})
    assert rounds == 1 and after.edges.count() == 3
    assert read.explain(after, "ca", "cb", "lens:x:theme").first().translated_from == ["may_be_related", "similar_to"]


def test_uuid5_and_times(spark):
    r = spark.sql("SELECT 'content:hi:a,b' AS t").select(uuid5("6ba7b8109dad11d180b400c04fd430c8", F.col("t")).alias("u")).first().u
    assert r == str(uuid.uuid5(uuid.NAMESPACE_DNS, "content:hi:a,b"))
    t = spark.createDataFrame([('"2026-03-18"',), ('"1970-01-01T00:00:01Z"',), ("5",), ("7.9",), ("true",)], "v string").select(enrich.epoch_ms(F.col("v")).alias("m"))
    assert [r.m for r in t.collect()] == [None, 1000, 5, 7, None]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def commerce(spark, tmp_path):
    """Two customers of one region and its neighbour; an order without lines; a part that nobody supplies."""
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "R0"), (1, "R1")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N0", 0), (1, "N1", 1)]),
        "customer": ("c_custkey int, c_mktsegment string, c_nationkey int", [(1, "a", 0), (2, "b", 0), (3, "c", 1)]),
        "supplier": ("s_suppkey int, s_name string, s_nationkey int", [(1, "S1", 0), (2, "S2", 1)]),
        "part": ("p_partkey int, p_brand string", [(1, "x"), (2, "y"), (3, "z")]),
        "orders": ("o_orderkey int, o_custkey int, o_orderstatus string", [(1, 1, "O"), (2, 3, "F"), (3, 3, "F")]),
        "lineitem": ("l_orderkey int, l_partkey int, l_suppkey int, l_quantity double, l_extendedprice double, l_discount double", [(1, 1, 1, 2.0, 9.0, 0.1), (2, 2, 2, 1.0, 5.0, 0.0), (2, 2, 2, 4.0, 7.0, 0.0)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    t = {name: rows for name, (_, rows) in tables.items()}
    nodes = [f"{k}:{r[0]}" for k, name in (("customer", "customer"), ("order", "orders"), ("part", "part"), ("supplier", "supplier"), ("nation", "nation"), ("region", "region")) for r in t[name]]
    edges = {(f"customer:{c}", f"order:{o}") for o, c, _ in t["orders"]} | {(f"customer:{c}", f"nation:{n}") for c, _, n in t["customer"]}
    edges |= {(f"order:{r[0]}", f"part:{r[1]}") for r in t["lineitem"]} | {(f"part:{r[1]}", f"supplier:{r[2]}") for r in t["lineitem"]}
    edges |= {(f"supplier:{x}", f"nation:{n}") for x, _, n in t["supplier"]} | {(f"nation:{n}", f"region:{r}") for n, _, r in t["nation"]}
    return nodes, edges


def test_registered_components_and_pagerank_cover_the_graph(spark, tmp_path):
    from skein.plans import registry

    nodes, edges = commerce(spark, tmp_path)
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert ids(registry.QUERIES["components"](spark, str(tmp_path))) == set(label.items()) and len(set(label.values())) == 3
    rank, out = dict.fromkeys(nodes, 1 / len(nodes)), {n: [b for a, b in edges if a == n] for n in nodes}
    for _ in range(20):
        got = dict.fromkeys(nodes, sum(rank[n] for n in nodes if not out[n]) / len(nodes))
        for n in nodes:
            for b in out[n]:
                got[b] += rank[n] / len(out[n])
        rank = {n: 0.15 / len(nodes) + 0.85 * got[n] for n in nodes}
    r = {x.id: x.pagerank for x in registry.QUERIES["pagerank"](spark, str(tmp_path)).collect()}
    assert r.keys() == rank.keys() and all(r[n] == pytest.approx(rank[n] * len(nodes), abs=2e-5) for n in nodes)
