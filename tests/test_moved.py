"""What queries move: rows shuffled and tables left behind, and that results stay those of plain Python."""

import os
import random

import numpy as np
import pytest

from skein.model import EDGE, NODE, Graph, shared_folder
from skein.operators import enrich


def shuffled(spark) -> int:
    """Rows written to shuffles by this session so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def tables(spark) -> int:
    return len(os.listdir(shared_folder(spark).removeprefix("file:")))


def graph(spark, pairs, ids):
    n = spark.createDataFrame([(i, "n", "document", "d", {}) for i in ids], NODE)
    return Graph(n, spark.createDataFrame([(a, b, "r", "d", "d", {}, 1.0, {}, k) for k, (a, b) in enumerate(pairs)], EDGE))


def layers(seed, n=40, deep=4):
    """Edges between one layer and the next, no cycles."""
    r = random.Random(seed)
    return sorted({(f"l{k}n{r.randrange(n)}", f"l{k + 1}n{r.randrange(n)}") for k in range(deep) for _ in range(3 * n)})


def ranks(pairs, ids, rounds, damping=0.85):
    """In rounds; what goes to ends that aren't nodes is lost, edges from them carry nothing."""
    out = {}
    for a, b in set(pairs):
        out.setdefault(a, []).append(b)
    r = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(rounds):
        got = {}
        for a in ids:
            for b in out.get(a, []):
                got[b] = got.get(b, 0) + r[a] / len(out[a])
        mass = 1 - sum(got.values())
        r = {i: (1 - damping) / len(ids) + damping * (got.get(i, 0) + mass / len(ids)) for i in ids}
    return r


@pytest.mark.parametrize("cycle", [False, True])
def test_pagerank_in_steps_is_pagerank_in_rounds(spark, cycle):
    pairs = layers(1) + [("l4n1", "l0n1"), ("l4n2", "l1n2"), ("l0n3", "gone"), ("gone", "l2n3"), ("l1n4", "l1n4")] * cycle
    ids = sorted({x for p in layers(1) for x in p} | {"alone"})
    got = {r.id: r.pagerank for r in enrich.pagerank(graph(spark, pairs + pairs[:9], ids), 20 if not cycle else 8).collect()}
    assert got == pytest.approx(ranks(pairs, ids, 20 if not cycle else 8), abs=1e-12)


def test_pagerank_moves_each_edge_a_few_times_and_leaves_one_table(spark):
    pairs = layers(2)
    g = graph(spark, pairs, sorted({x for p in pairs for x in p}))
    rows, left = shuffled(spark), tables(spark)
    enrich.pagerank(g)
    assert shuffled(spark) - rows < 8 * len(pairs) and tables(spark) - left == 1


def vectors(spark, n, width=6, seed=3):
    e = np.random.default_rng(seed).standard_normal((n, width)).astype(np.float32)
    e[n // 2] = e[0]
    return e, spark.createDataFrame([(f"v{i}", x.tolist(), i % 3) for i, x in enumerate(e)], "id string, embedding array<float>, label int")


def test_nearest_vectors_leave_a_task_as_few_and_are_sent_to_few_blocks(spark, tmp_path):
    from skein.operators import vectors as V

    n = 2_500
    e, v = vectors(spark, n)
    store = V.VectorStore(str(tmp_path))
    store.store(v, "m")
    rows = shuffled(spark)
    got = store.find_similar(v, "m", 0.2, 3).collect()
    assert shuffled(spark) - rows < 60 * n
    u = e.astype(float) / np.linalg.norm(e.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = np.sort(s, axis=1)[:, :-4:-1]
    near = {}
    for r in got:
        near.setdefault(r.id, []).append(r.similarity)
    assert len(near) == n
    assert all(sorted(near[f"v{i}"], reverse=True) == pytest.approx(best[i][best[i] >= 0.2], abs=1e-6) for i in range(n))


def test_blocks_follow_the_input_up_to_what_a_task_holds():
    from skein.operators import blocks

    assert [blocks.number(n) for n in (0, 2_048, 2_049, 100_000, 500_000, 655_360)] == [1, 1, 2, 8, 8, 10]
    s = np.random.default_rng(1).integers(0, 9, (50, 4)).astype(float)
    t = np.random.default_rng(2).integers(0, 9, (900, 4)).astype(float)
    found = {(i, j) for a, b, _ in blocks.products(s, t, 0, 4) for i, j in zip(a, b)}
    whole = s @ t.T
    assert found >= {(i, j) for i in range(50) for j in range(900) if whole[i, j] >= np.sort(whole[i])[-4]} and len(found) < 5_000


def test_pairs_are_brute_force(spark):
    from skein.operators import blocks

    e, v = vectors(spark, 2_100)
    u = e.astype(float) / np.linalg.norm(e.astype(float), axis=1, keepdims=True)
    i, j = np.nonzero(u @ u.T >= 0.97)
    want = {(f"v{a}", f"v{b}", a % 3, b % 3) for a, b in zip(i.tolist(), j.tolist()) if f"v{a}" < f"v{b}"}
    assert {(r.source, r.target, r.source_label, r.target_label) for r in blocks.pairs(v, 0.97, ("label",)).collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_discovery_gap_gathers_each_edge_once(spark, seed):
    r = random.Random(seed)
    ids = [f"n{i:02}" for i in range(40)]
    keys = sorted({(r.choice(ids), r.choice(ids), r.choice(["similar_to"] * 6 + ["discovery_gap", "cites"])) for _ in range(700)})
    rows = [(a, b, k, "d", "d", {}, r.random(), {}, i) for i, (a, b, k) in enumerate(keys)]
    g = Graph(spark.createDataFrame([(i, "n", "document", "d", {}) for i in ids], NODE), spark.createDataFrame(rows, EDGE))
    there = {k[:2] for k in keys if k[2] == "discovery_gap"}
    known = {p for a, b, k in keys if k == "cites" for p in ((a, b), (b, a))}
    want = {}
    for a, b, k, *_, w, _, seq in rows:
        if k == "similar_to" and (a, b) not in known | there:
            for p in {(a, b), (b, a)} - there:
                want[p] = max(want.get(p, (-1,)), (seq, w))
    before = shuffled(spark)
    got = {(e.source, e.target): e.raw_weight for e in enrich.discovery_gap(g).collect()}
    assert got == {p: w for p, (_, w) in want.items()} and shuffled(spark) - before <= len(rows)


def parts(pairs, ids):
    label = {i: i for i in ids}
    while True:
        new = dict(label)
        for a, b in pairs:
            if a in new and b in new:
                new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("missing", [False, True])
def test_components_follow_chains_and_skip_missing_ends(spark, missing):
    r = random.Random(4)
    ids = [f"n{i:03}" for i in range(120)]
    chain = ids[:20]
    pairs = list(zip(chain, chain[1:])) + [(ids[39], x) for x in ids[20:39]] + [(r.choice(ids[40:]), r.choice(ids[40:])) for _ in range(50)] + [("n050", "n050")]
    pairs += [("a", "n001"), ("a", "n030"), ("z", "n040"), ("z", "n070"), ("a", "b"), ("n100", "a")] * missing
    got = {x.id: x.component for x in enrich.components(graph(spark, pairs, ids)).collect()}
    assert got == parts(pairs, ids) and len(set(got.values())) > 10


def test_components_move_each_edge_a_few_times(spark):
    pairs = layers(5, 150)
    g = graph(spark, pairs, sorted({x for p in pairs for x in p}))
    rows, left = shuffled(spark), tables(spark)
    enrich.components(g)
    assert shuffled(spark) - rows < 7 * len(pairs) and tables(spark) - left <= 2


@pytest.mark.parametrize("missing", [False, True])
def test_label_propagation_moves_votes_only(spark, missing):
    from skein.adapters import analysis

    r = random.Random(6)
    ids = [f"n{i:03}" for i in range(150)]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(900)]
    pairs += [(b, a) for a, b in pairs[:50]] + [(ids[3], ids[3])] + [("a", ids[1]), ("z", ids[2]), ("a", "z")] * missing
    near = {i: {b for p in pairs for a, b in (p, p[::-1]) if a == i != b and b in ids} for i in ids}
    label = {i: i for i in ids}
    for _ in range(3):
        votes = {i: [label[o] for o in near[i]] for i in ids}
        label = {i: min(set(v), key=lambda x: (-v.count(x), x)) if v else label[i] for i, v in votes.items()}
    g = graph(spark, pairs, ids)
    rows, left = shuffled(spark), tables(spark)
    got = {x.id: x.community for x in analysis.label_propagation(g, 3).collect()}
    assert got == label and shuffled(spark) - rows < 8 * len(pairs) and tables(spark) - left == 1


def test_temporal_pairs_meet_once_in_two_buckets(spark):
    r = random.Random(8)
    times = [r.randrange(0, 5_000) for _ in range(150)] + [-70, -1, 0, 99, 100, 100, 4_000]
    n = spark.createDataFrame([(f"t{i}", "fragment", "document", "d", {"created_at": str(m)}) for i, m in enumerate(times)], NODE)
    rows = shuffled(spark)
    got = [(e.source, e.target) for e in enrich.temporal_proximity(Graph(n, graph(spark, [], ["x"]).edges), threshold_ms=100).collect()]
    moved = shuffled(spark) - rows
    want = {(f"t{i}", f"t{j}") for i, a in enumerate(times) for j, b in enumerate(times) if i != j and abs(a - b) <= 100}
    assert len(got) == len(want) and set(got) == want and moved <= 3 * len(times)


def test_ranks_by_source_need_the_edges_of_those_sources(spark):
    from skein.operators import read

    pairs = layers(9)
    g = graph(spark, pairs, sorted({x for p in pairs for x in p}))
    origin = pairs[0][0]
    levels, edges = read.traverse(g, origin, 1)
    edges, rows = edges.cache(), shuffled(spark)
    edges.count()
    rows = shuffled(spark)
    got = {x.id: x.score for x in read.rank(levels, edges, "normalized", read.outgoing_divisive, g.edges).collect()}
    out = [b for a, b in pairs if a == origin]
    assert got == {i: pytest.approx(1 / len(out)) for i in [origin, *out]} and shuffled(spark) - rows < len(pairs) / 2


def test_events_carry_digests_in_32_bytes(spark):
    from skein.model import edge_id
    from skein.operators import write

    pairs = layers(10)
    g = graph(spark, pairs, sorted({x for p in pairs for x in p}))
    e = write.apply(g, write.Emission(removals=g.nodes.where("id like 'l1%'").select("id")), "x").events("x")
    assert "unhex" in e._jdf.queryExecution().toString()
    (ids,) = [x.edge_ids for x in e.collect() if x.event_type == "EdgesRemoved"]
    gone = g.edges.where("source like 'l1%' or target like 'l1%'")
    assert ids == sorted(x.i for x in gone.select(edge_id().alias("i")).collect())


def test_path_edges_join_the_steps_before_edges_are_shuffled(spark, tmp_path):
    from skein.plans import engine
    from tests.test_graph import commerce

    commerce(spark, tmp_path)
    t = engine.QUERIES["path_edges"](spark, str(tmp_path))
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and t.first().edges == 0  # there is no region:2
