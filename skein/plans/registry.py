"""Every registered query of the graph engine, over whole tables, with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Graph, concept_id, fragment_id, saved
from ..adapters import analysis
from ..operators import blocks, enrich, read, write
from ..operators.filters import EdgeFilter, adjacency
from ..sources import tables as T

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _with(nodes: str, edges: str, rest: str, recursive: bool = False) -> str:
    return f"""WITH {'RECURSIVE ' if recursive else ''}N AS ({nodes}), E0 AS ({edges}), M AS (SELECT max(abs(q)) AS mq, max(abs(r)) AS mr FROM E0),
E AS (SELECT source, target, relationship, sd, td, q, r, CASE WHEN q IS NULL AND r IS NULL THEN 1.0 ELSE coalesce(q / mq, 0) + coalesce(r / mr, 0) END AS w FROM E0, M) {rest}"""


def C(rest, recursive=False):
    return _with(T.COMMERCE_NODES, T.COMMERCE_EDGES, rest, recursive)


def G(rest, recursive=False):
    return _with(T.TAG_NODES, T.TAG_EDGES, rest, recursive)


def P(rest, recursive=False):
    return _with(T.PROV_NODES, T.PROV_EDGES, rest, recursive)


def R6(c):
    """Six decimals. A billionth is added here and in the oracle: the two engines round decimal ties differently."""
    return F.round(F.col(c) + 1e-9, 6)


def _kept(g):
    """The graph with its edges as a table, where a plan reads them more than once."""
    return Graph(g.nodes, saved(g.edges))


def W6():
    return R6("raw_weight").alias("weight")


EDGE3 = ["source", "target", "relationship"]


# -- find --------------------------------------------------------------------------------------------------------------
@query(C("SELECT id, node_type FROM N WHERE node_type = 'part'"))
def find_by_type(s, d):
    return read.find(T.commerce(s, d, False), node_type="part").select("id", "node_type")


@query(C("SELECT id FROM N WHERE pkey = 'brand' AND pval = 'Brand#11'"))
def find_by_property(s, d):
    return read.find(T.commerce(s, d, False), property_equals=("brand", '"Brand#11"')).select("id")


@query(C("SELECT id, dimension FROM N WHERE pkey = 'segment'"))
def find_has_property(s, d):
    return read.find(T.commerce(s, d, False), has_property="segment").select("id", "dimension")


@query(C("SELECT id, (SELECT count(*) FROM N WHERE node_type = 'customer') AS total_count FROM N WHERE node_type = 'customer' ORDER BY id LIMIT 25 OFFSET 50"))
def find_paged(s, d):
    return read.find(T.commerce(s, d, False), node_type="customer", offset=50, limit=25, total=True).select("id", "total_count")


@query(C("SELECT id FROM N WHERE id IN (SELECT source FROM E WHERE q IS NOT NULL AND r IS NOT NULL UNION SELECT target FROM E WHERE q IS NOT NULL AND r IS NOT NULL)"))
def find_with_corroboration(s, d):
    return read.find(T.commerce(s, d, False), edge_filter=EdgeFilter(min_corroboration=2)).select("id")


@query(C("SELECT id FROM N WHERE id IN (SELECT source FROM E WHERE relationship LIKE 'loc%' UNION SELECT target FROM E WHERE relationship LIKE 'loc%')"))
def find_with_prefix(s, d):
    return read.find(T.commerce(s, d, False), edge_filter=EdgeFilter(prefix="loc")).select("id")


@query(C("SELECT id FROM N WHERE id IN (SELECT source FROM E WHERE r IS NOT NULL UNION SELECT target FROM E WHERE r IS NOT NULL)"))
def find_with_contributors(s, d):
    return read.find(T.commerce(s, d, False), edge_filter=EdgeFilter(contributors=["revenue"])).select("id")


# -- traverse, path, steps ---------------------------------------------------------------------------------------------
def _bfs(origin, depth, adj, cond="true"):
    return f""", A AS ({adj.format(cond=cond)}), B AS (SELECT id, 0 AS level FROM N WHERE id = '{origin}' UNION SELECT A.t, B.level + 1 FROM B JOIN A ON A.h = B.id JOIN N ON N.id = A.t WHERE B.level < {depth}),
L AS (SELECT id, min(level) AS level FROM B GROUP BY id)"""


OUT = "SELECT source AS h, target AS t, w FROM E WHERE {cond}"
IN = "SELECT target AS h, source AS t, w FROM E WHERE {cond}"
BOTH = OUT + " UNION ALL " + IN


@query(C(_bfs("customer:1", 1, OUT) + " SELECT id, level FROM L", True))
def traverse_out_d1(s, d):
    return read.traverse(T.commerce(s, d, False), "customer:1", 1)[0].select("id", F.col("level").cast("int").alias("level"))


@query(C(_bfs("nation:3", 2, IN) + " SELECT id, level FROM L", True))
def traverse_in_d2(s, d):
    return read.traverse(T.commerce(s, d, False), "nation:3", 2, "incoming")[0]


@query(C(_bfs("customer:1", 2, BOTH) + " SELECT id, level FROM L", True))
def traverse_both_d2(s, d):
    return read.traverse(T.commerce(s, d, False), "customer:1", 2, "both")[0]


@query(C(_bfs("customer:1", 3, OUT, "w >= 0.5") + " SELECT id, level FROM L", True))
def traverse_min_weight(s, d):
    return read.traverse(T.commerce(s, d), "customer:1", 3, min_weight=0.5)[0]


@query(C(_bfs("region:1", 3, IN, "relationship = 'located_in'") + " SELECT id, level FROM L", True))
def traverse_relationship(s, d):
    return read.traverse(T.commerce(s, d, False), "region:1", 3, "incoming", "located_in")[0]


@query(C(_bfs("order:1", 2, BOTH, "relationship = 'contains'") + ", X AS (SELECT id FROM L WHERE level < 2) SELECT source, target, relationship FROM E WHERE relationship = 'contains' AND (source IN (SELECT id FROM X) OR target IN (SELECT id FROM X))", True))
def traverse_edges(s, d):
    return read.traverse(T.commerce(s, d, False), "order:1", 2, "both", "contains")[1].select(EDGE3)


@query(C(_bfs("order:1", 2, BOTH, "q IS NOT NULL AND r IS NOT NULL") + " SELECT id, level FROM L", True))
def traverse_filtered(s, d):
    return read.traverse(T.commerce(s, d, False), "order:1", 2, "both", edge_filter=EdgeFilter(min_corroboration=2))[0]


_RANK = """, X AS (SELECT id FROM L WHERE level < {depth}), R AS (SELECT * FROM E WHERE source IN (SELECT id FROM X)), S AS (SELECT id, greatest(max(v), 0) AS score FROM (SELECT source AS id, {v} AS v FROM R UNION ALL SELECT target, {v} FROM R) GROUP BY id)
SELECT L.id, L.level, round(coalesce(score, 0) + 1e-9, 6) AS score FROM L LEFT JOIN S USING (id)"""


@query(C(_bfs("customer:1", 2, OUT) + _RANK.format(depth=2, v="w"), True))
def traverse_ranked(s, d):
    levels, edges = read.traverse(T.commerce(s, d), "customer:1", 2)
    return read.rank(levels, edges).select("id", "level", R6("score").alias("score"))


@query(C(_bfs("customer:1", 2, OUT) + _RANK.format(depth=2, v="(CASE WHEN q IS NULL THEN 0 ELSE 1 END + CASE WHEN r IS NULL THEN 0 ELSE 1 END)::DOUBLE"), True))
def rank_corroboration(s, d):
    levels, edges = read.traverse(T.commerce(s, d), "customer:1", 2)
    return read.rank(levels, edges, "corroboration").select("id", "level", R6("score").alias("score"))


@query(C(_bfs("customer:1", 2, OUT) + _RANK.format(depth=2, v="w / (SELECT sum(w) FROM E x WHERE x.source = R.source)"), True))
def rank_normalized(s, d):
    g = T.commerce(s, d)
    levels, edges = read.traverse(g, "customer:1", 2)
    return read.rank(levels, edges, "normalized", read.outgoing_divisive, g.edges).select("id", "level", R6("score").alias("score"))


@query(C(_bfs("customer:1", 6, BOTH) + " SELECT level AS length FROM L WHERE id = 'region:2'", True))
def path_length(s, d):
    p = read.shortest_path(T.commerce(s, d, False), "customer:1", "region:2", 6, "both")
    return s.createDataFrame([] if p is None else [(len(p) - 1,)], "length int")


@query(C(_bfs("customer:1", 4, OUT, "relationship = 'located_in'") + " SELECT level AS length FROM L WHERE id LIKE 'region:%'", True))
def path_filtered(s, d):
    g = T.commerce(s, d, False)
    region = [r.id for r in read.traverse(g, "customer:1", 4, "outgoing", "located_in")[0].where("id like 'region:%'").collect()]
    p = [read.shortest_path(g, "customer:1", r, 4, "outgoing", "located_in") for r in region]
    return s.createDataFrame([(len(x) - 1,) for x in p if x], "length int")


@query(C(", A AS (SELECT DISTINCT target AS id FROM E WHERE source = 'customer:1' AND relationship = 'placed'), B AS (SELECT DISTINCT target AS id FROM E JOIN A ON source = A.id WHERE relationship = 'contains') SELECT id, 1 AS level FROM A UNION ALL SELECT id, 2 FROM B"))
def step_two_hops(s, d):
    return read.steps(T.commerce(s, d, False), "customer:1", [("outgoing", "placed"), ("outgoing", "contains")])[0]


@query(C(", A AS (SELECT DISTINCT source AS id FROM E WHERE target = 'part:7' AND relationship = 'contains'), B AS (SELECT DISTINCT source AS id FROM E JOIN A ON target = A.id WHERE relationship = 'placed') SELECT id, 1 AS level FROM A UNION ALL SELECT id, 2 FROM B"))
def step_reverse(s, d):
    return read.steps(T.commerce(s, d, False), "part:7", [("incoming", "contains"), ("incoming", "placed")])[0]


@query(P(", A AS (SELECT source AS id FROM E WHERE target = 'concept:user' AND relationship = 'references') SELECT id, 'mark' AS kind FROM A UNION ALL SELECT DISTINCT source, 'chain' FROM E JOIN A ON target = A.id WHERE relationship = 'contains'"))
def evidence_marks(s, d):
    return read.evidence(T.provenance(s, d), "concept:user")[0]


@query(G("SELECT source AS id, 'fragment' AS kind FROM E WHERE target = (SELECT min(id) FROM N WHERE node_type = 'concept')"))
def evidence_fragments(s, d):
    g = T.tags(s, d)
    c = g.nodes.where("node_type = 'concept'").agg(F.min("id")).first()[0]
    return read.evidence(g, c)[0]


_PAIR = "(SELECT min(source || '|' || target) AS k FROM E0 WHERE relationship = 'contains')"


@query(C(f"SELECT relationship, 'reverse' AS direction, round(w + 1e-9, 6) AS weight, (q IS NOT NULL)::BIGINT + (r IS NOT NULL)::BIGINT AS corroboration FROM E WHERE source || '|' || target = {_PAIR}"))
def explain_pair(s, d):
    g = T.commerce(s, d)
    a, b = g.edges.where("relationship = 'contains'").agg(F.min(F.concat_ws("|", "source", "target"))).first()[0].split("|")
    return read.explain(g, b, a).select("relationship", "direction", W6(), "corroboration")


@query("SELECT DISTINCT 'concept:' || lower(p_brand || ':' || p_type) AS id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate < TIMESTAMP '1998-05-01' INTERSECT SELECT DISTINCT 'concept:' || lower(p_brand || ':' || p_type) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1998-05-01'")
def shared_concepts(s, d):
    T.views(s, d)
    q = "SELECT DISTINCT 'concept:' || lower(p_brand || ':' || p_type) AS id, 'concept' AS node_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate {} TIMESTAMP '1998-05-01'"
    return read.shared_concepts(Graph(s.sql(q.format("<")), None), Graph(s.sql(q.format(">=")), None))


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("sequence"), "event_type", F.concat(F.lit("user:"), "user_id").alias("adapter_id"))


@query("SELECT event_id AS sequence, event_type FROM events WHERE event_id > 500 AND event_type IN ('click', 'view')")
def changes_since(s, d):
    return read.changes_since(_events(s, d), 500, event_types=["click", "view"]).select("sequence", "event_type")


@query("SELECT (SELECT max(event_id) FROM events) AS latest")
def changes_latest(s, d):
    e = _events(s, d)
    return s.createDataFrame([(read.latest_sequence(e, read.changes_since(e, 10, adapter_id="nobody"), 10),)], "latest bigint")


# -- weights -----------------------------------------------------------------------------------------------------------
@query(C("SELECT source, target, relationship, round(w / sum(w) OVER (PARTITION BY source) + 1e-9, 6) AS normalized FROM E"))
def norm_divisive(s, d):
    return read.outgoing_divisive(T.commerce(s, d).edges).select(*EDGE3, R6("normalized_weight").alias("normalized"))


@query(C(", X AS (SELECT *, exp(w - max(w) OVER (PARTITION BY source)) AS x FROM E) SELECT source, target, relationship, round(x / sum(x) OVER (PARTITION BY source) + 1e-9, 6) AS normalized FROM X"))
def norm_softmax(s, d):
    return read.softmax(T.commerce(s, d).edges).select(*EDGE3, R6("normalized_weight").alias("normalized"))


@query(C("SELECT source, target, relationship, round(w + 1e-9, 6) AS weight FROM E"))
def weights_maxabs(s, d):
    return T.commerce(s, d).edges.select(*EDGE3, W6())


@query(C("SELECT source, target, relationship, round(CASE WHEN q IS NULL THEN 1.0 ELSE q / mq END + 1e-9, 6) AS weight FROM E, M WHERE q IS NOT NULL OR r IS NULL"))
def retract_contributions(s, d):
    return write.retract(T.commerce(s, d, False), "revenue")[0].edges.select(*EDGE3, W6())


@query(C("SELECT count(*) FILTER (r IS NOT NULL) AS affected, count(*) FILTER (r IS NOT NULL AND q IS NULL) AS pruned FROM E"))
def retract_counts(s, d):
    return write.retract(T.commerce(s, d, False), "revenue")[1]


_SUPPLIED = "SELECT source, target, relationship, sd, td, CASE WHEN relationship = 'supplied_by' THEN q * 2 ELSE q END AS q, r FROM E0"


@query(C(f", X AS ({_SUPPLIED}), Y AS (SELECT max(q) AS mq, max(r) AS mr FROM X) SELECT source, target, relationship, round(CASE WHEN q IS NULL AND r IS NULL THEN 1.0 ELSE coalesce(q / Y.mq, 0) + coalesce(r / Y.mr, 0) END + 1e-9, 6) AS weight FROM X, Y"))
def merge_edges(s, d):
    g = T.commerce(s, d, False)
    twice = g.edges.where("relationship = 'supplied_by'").withColumn("contributions", F.transform_values("contributions", lambda k, v: v * 2))
    return write.recompute_weights(write.merge_edges(g.edges, twice)).select(*EDGE3, W6())


@query(C("SELECT source, target, relationship, '2' AS n FROM E WHERE relationship = 'placed' UNION ALL SELECT source, target, relationship, '2' FROM E WHERE relationship = 'placed'"))
def cross_dim_count(s, d):
    g = T.commerce(s, d, False)
    again = g.edges.where("relationship = 'placed'").withColumn("target_dimension", F.lit("semantic"))
    e = write.merge_edges(g.edges.where("relationship = 'placed'"), again)
    return e.select(*EDGE3, F.col("properties")["_cross_dim_count"].alias("n"))


@query(C("SELECT source, target, relationship FROM E WHERE sd <> td"))
def cross_dimensional(s, d):
    return T.commerce(s, d, False).edges.where(read.cross_dimensional()).select(EDGE3)


@query(C("SELECT id, CASE WHEN node_type = 'nation' THEN 'state' ELSE node_type END AS node_type FROM N"))
def upsert_nodes(s, d):
    g = T.commerce(s, d, False)
    new = g.nodes.where("node_type = 'nation'").withColumn("node_type", F.lit("state"))
    return write.upsert_nodes(g.nodes, new).select("id", "node_type")


@query(C("SELECT id, CASE WHEN node_type = 'nation' THEN 2 ELSE 1 END AS n FROM N"))
def property_update(s, d):
    g = T.commerce(s, d, False)
    up = g.nodes.where("node_type = 'nation'").select("id", F.create_map(F.lit("rank"), F.lit("1")).alias("properties"))
    return write.update_properties(g.nodes, up).select("id", F.size("properties").alias("n"))


@query(C("SELECT source, target, relationship FROM E WHERE source NOT LIKE 'nation:%' AND target NOT LIKE 'nation:%'"))
def remove_cascade(s, d):
    g = T.commerce(s, d, False)
    return write.remove_nodes(g, g.nodes.where("node_type = 'nation'")).edges.select(EDGE3)


@query(C("SELECT source, target, CASE WHEN source LIKE 'supplier:%' THEN 'missing source' ELSE 'missing target' END AS reason FROM E WHERE source LIKE 'supplier:%' OR target LIKE 'supplier:%'"))
def reject_missing(s, d):
    g = T.commerce(s, d, False)
    return write.check_ends(g.edges, g.nodes.where("node_type <> 'supplier'"))[1].select("source", "target", "reason")


# -- enrichments -------------------------------------------------------------------------------------------------------
_CO = ", X AS (SELECT a.target AS s, b.target AS t, count(*) AS n FROM E a JOIN E b ON a.source = b.source AND a.target < b.target GROUP BY 1, 2), Y AS (SELECT s, t, n / (SELECT max(n) FROM X)::DOUBLE AS w FROM X), Z AS (SELECT s, t, w FROM Y UNION ALL SELECT t, s, w FROM Y)"


@query(G(_CO + " SELECT s AS source, t AS target, round(w + 1e-9, 6) AS weight FROM Z"))
def cooccurrence(s, d):
    return enrich.cooccurrence(_kept(T.tags(s, d))).select("source", "target", W6())


@query(G(_CO + " SELECT s AS source, t AS target, 'lens:shop:goes_with' AS relationship, round(w + 1e-9, 6) AS weight FROM Z WHERE w >= 0.5"))
def lens_translate(s, d):
    g = _kept(T.tags(s, d))
    g = Graph(g.nodes, enrich.cooccurrence(g))
    return enrich.lens(g, "shop", [enrich.Translation(("may_be_related",), "goes_with", 0.5)]).select(*EDGE3, W6())


@query(G(_CO + " SELECT s AS source, t AS target, 2::BIGINT AS n FROM Z WHERE w >= 0.5"))
def lens_corroborated(s, d):
    g = _kept(T.tags(s, d))
    e = saved(enrich.cooccurrence(g))
    e = e.unionByName(e.where("raw_weight >= 0.5").withColumn("relationship", F.lit("similar_to")))
    return enrich.lens(Graph(g.nodes, e), "shop", [enrich.Translation(("may_be_related", "similar_to"), "goes_with", 0.0, 2)]).select("source", "target", F.size("contributions").cast("long").alias("n"))


_EV = "WITH V AS (SELECT 'event:' || event_id AS id, epoch_us(ts) // 1000 AS ms FROM events), X AS (SELECT a.id AS s, b.id AS t FROM (SELECT *, ms // 60000 AS k FROM V) a JOIN (SELECT *, unnest([ms // 60000 - 1, ms // 60000, ms // 60000 + 1]) AS k FROM V) b USING (k) WHERE abs(a.ms - b.ms) <= 60000 AND a.id < b.id)"


@query(_EV + " SELECT s AS source, t AS target FROM X UNION ALL SELECT t, s FROM X")
def temporal_proximity(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    n = e.select(F.concat(F.lit("event:"), "event_id").alias("id"), F.lit("event").alias("node_type"), F.create_map(F.lit("created_at"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).alias("properties"))
    g = Graph(n, s.createDataFrame([], "source string, target string, relationship string"))
    return enrich.temporal_proximity(g, threshold_ms=60_000, node_types=None).select("source", "target")


_VEC = "WITH V AS (SELECT 'vec:' || vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), X AS (SELECT a.id AS s, b.id AS t, a.label AS la, b.label AS lb, list_cosine_similarity(a.e, b.e) AS w FROM V a JOIN V b ON a.id < b.id), Y AS (SELECT * FROM X WHERE w >= 0.3)"


def _vectors(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("vec:"), "vec_id").alias("id"), "embedding", "label")


@query(_VEC + " SELECT s AS source, t AS target, round(w, 5) AS weight FROM Y UNION ALL SELECT t, s, round(w, 5) FROM Y")
def embedding_similar(s, d):
    v = _vectors(s, d)
    g = Graph(v.select("id"), s.createDataFrame([], "source string, target string, relationship string"))
    return enrich.embedding_similarity(g, v, "table", 0.3).select("source", "target", F.round("raw_weight", 5).alias("weight"))


@query(_VEC + " SELECT s AS source, t AS target FROM Y WHERE la <> lb UNION ALL SELECT t, s FROM Y WHERE la <> lb")
def discovery_gap(s, d):
    v = _vectors(s, d)
    kinds = F.when(F.col("source_label") == F.col("target_label"), F.array(F.lit("similar_to"), F.lit("same_label"))).otherwise(F.array(F.lit("similar_to")))
    g = Graph(v.select("id"), enrich._edges(blocks.pairs(v, 0.3, ("label",)), F.explode(kinds), "table"))
    return enrich.discovery_gap(g).select("source", "target")


_LOOP = ", K AS (SELECT 'tagged_with' AS relationship, count(*) AS n FROM E UNION ALL SELECT 'may_be_related', count(*) FROM Z UNION ALL SELECT 'lens:shop:goes_with', count(*) FROM Z WHERE w >= 0.5) SELECT relationship, n, 2 AS rounds FROM K WHERE n > 0"


@query(G(_CO + _LOOP))
def enrichment_loop(s, d):
    g, rounds = enrich.run_loop(_kept(T.tags(s, d)), {"co": enrich.cooccurrence, "lens": lambda g: enrich.lens(g, "shop", [enrich.Translation(("may_be_related",), "goes_with", 0.5)])})
    return g.edges.groupBy("relationship").agg(F.count("*").alias("n")).withColumn("rounds", F.lit(rounds))


def _rounds(n: int, first: str, step: str, last: str) -> str:
    """SQL of a fixed number of rounds: R0, R1, ..."""
    return ", R0 AS (" + first + ")" + "".join(f", R{k + 1} AS MATERIALIZED ({step.format(R=f'R{k}')})" for k in range(n)) + f" {last.format(R=f'R{n}')}"


_BOTH_ENDS = ", A AS (SELECT DISTINCT source AS v, target AS o FROM E UNION SELECT target, source FROM E)"
_COMPONENTS = _rounds(14, "SELECT id, id AS component FROM N", "SELECT r.id, least(r.component, coalesce(min(x.component), r.component)) AS component FROM {R} r LEFT JOIN A ON A.v = r.id LEFT JOIN {R} x ON x.id = A.o GROUP BY r.id, r.component", "SELECT id, component FROM {R}")
_PAGERANK = ", D AS (SELECT DISTINCT source, target FROM E), G AS (SELECT source, count(*) AS deg FROM D GROUP BY source), C AS (SELECT count(*) AS n FROM N)" + _rounds(
    20,
    "SELECT id, 1.0::DOUBLE / n AS r FROM N, C",
    "SELECT N.id, 0.15 / n + 0.85 * (coalesce(i, 0) + (1 - (SELECT coalesce(sum(r), 0) FROM {R} JOIN G ON G.source = {R}.id)) / n) AS r FROM N CROSS JOIN C LEFT JOIN (SELECT D.target AS id, sum(r.r / deg) AS i FROM {R} r JOIN G ON G.source = r.id JOIN D ON D.source = r.id GROUP BY D.target) x ON x.id = N.id",
    "SELECT id, round(r * (SELECT n FROM C) + 1e-9, 5) AS pagerank FROM {R}",
)
_COMMUNITIES = _rounds(2, "SELECT id, id AS community FROM N", "SELECT r.id, coalesce(b.l, r.community) AS community FROM {R} r LEFT JOIN (SELECT v, arg_min(l, (-n, l)) AS l FROM (SELECT A.v, x.community AS l, count(*) AS n FROM A JOIN {R} x ON x.id = A.o WHERE A.v <> A.o GROUP BY 1, 2) GROUP BY v) b ON b.v = r.id", "SELECT id, community FROM {R}")


@query(C(_BOTH_ENDS + _COMMUNITIES))
def label_propagation(s, d):
    return analysis.label_propagation(T.commerce(s, d, False), 2)


@query(C(_BOTH_ENDS + _COMPONENTS))
def components(s, d):
    return enrich.components(T.commerce(s, d, False))


@query(C(_PAGERANK))
def pagerank(s, d):
    """Ranks times the number of nodes, so that five decimals say something."""
    g = T.commerce(s, d, False)
    n = g.nodes.count()
    return enrich.pagerank(g).select("id", F.round(F.col("pagerank") * n + 1e-9, 5).alias("pagerank"))


# -- provenance views and adapters -------------------------------------------------------------------------------------
@query("SELECT DISTINCT 'chain:' || conv_id AS id, 'conversation ' || conv_id AS name, 'active' AS status FROM conversations")
def list_chains(s, d):
    return read.list_chains(T.provenance(s, d), "active")


@query("SELECT 'mark:' || conv_id || ':' || turn AS id, 'chain:' || conv_id AS chain_id FROM conversations")
def list_marks(s, d):
    return read.list_marks(T.provenance(s, d)).select("id", "chain_id")


@query("SELECT 'mark:' || conv_id || ':' || turn AS id FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def chain_marks(s, d):
    g = T.provenance(s, d)
    c = s.table("conversations").agg(F.min("conv_id")).first()[0]
    return read.get_chain(g, f"chain:{c}")[1].select("id")


@query("SELECT 'mark:' || a.conv_id || ':' || a.turn AS id, 'mark:' || b.conv_id || ':' || b.turn AS link FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def mark_links(s, d):
    return read.list_marks(T.provenance(s, d)).select("id", F.explode("links").alias("link"))


@query(C("SELECT id, node_type AS type, dimension, CASE WHEN pkey = 'label' THEN pval ELSE '' END AS label FROM N"))
def graph_export(s, d):
    return read.export(T.commerce(s, d, False))[0]


@query(C("SELECT h AS here, count(*) AS n FROM (SELECT source AS h FROM E UNION ALL SELECT target FROM E) GROUP BY h"))
def adjacency_both(s, d):
    return adjacency(T.commerce(s, d, False).edges, "both").groupBy("here").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'concept:' || lower(lang) AS concept FROM documents")
def content_concepts(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", concept_id(F.col("lang")).alias("concept"))
