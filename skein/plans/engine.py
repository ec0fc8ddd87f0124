"""Registered queries of adapters, specs, the write protocol and the event log, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import analysis, content, files, provenance, router, semantic
from ..functions import templates
from ..model import Graph, empty, fragment_id, saved
from ..operators import enrich, read, vectors, write
from ..operators.write import Emission
from ..sources import tables as T
from ..spec import declarative
from .registry import _CO, _RANK, BOTH, C, EDGE3, G, OUT, P, QUERIES, R6, _bfs, _kept, query

__all__ = ["QUERIES"]
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def _uuid5(text: str, ns: str = DNS) -> str:
    h = f"sha1(unhex('{ns}') || encode({text}))"
    return f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"


# -- content -----------------------------------------------------------------------------------------------------------
_FRAGMENT = "'fragment:' || " + _uuid5("'content:' || text || ':' || array_to_string(list_sort([lower(lang), lower(source)]), ',')")
_DOCS = f"WITH D AS (SELECT doc_id, text, lang, source, {_FRAGMENT} AS f FROM documents WHERE text IS NOT NULL)"
_NODES = " SELECT DISTINCT f AS id, 'fragment' AS node_type FROM D UNION ALL SELECT DISTINCT 'mark:content:' || f, 'mark' FROM D UNION ALL SELECT DISTINCT 'chain:content:' || source, 'chain' FROM D UNION ALL SELECT DISTINCT 'concept:' || t, 'concept' FROM (SELECT lower(lang) AS t FROM D UNION SELECT lower(source) FROM D)"
_EDGES = " SELECT DISTINCT f AS source, 'concept:' || t AS target, 'tagged_with' AS relationship FROM (SELECT f, unnest([lower(lang), lower(source)]) AS t FROM D) UNION ALL SELECT DISTINCT 'chain:content:' || source, 'mark:content:' || f, 'contains' FROM D"


def _inputs(s, d):
    t = s.read.parquet(f"{d}/documents.parquet")
    return t.select(F.col("doc_id").alias("ord"), "text", F.array("lang", "source").alias("tags"), "source")


def _ingested(s, d) -> write.Result:
    return write.apply(empty(s), content.emission(_inputs(s, d)), "content")


@query(f"WITH D AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents) SELECT doc_id, {_FRAGMENT} AS fragment FROM D")
def content_fragments(s, d):
    t = s.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", fragment_id(F.lit("content"), F.coalesce("text", F.lit("")), F.array("lang", "source")).alias("fragment"))


@query(_DOCS + _NODES)
def ingest_content(s, d):
    return _ingested(s, d).graph.nodes.select("id", "node_type")


@query(_DOCS + _EDGES)
def ingest_content_edges(s, d):
    return _ingested(s, d).graph.edges.select(EDGE3)


@query(_DOCS + f", V AS ({_NODES}), X AS ({_EDGES}) SELECT 1::BIGINT AS sequence, 'NodesAdded' AS event_type, count(*) AS n FROM V UNION ALL SELECT 2, 'EdgesAdded', count(*) FROM X")
def cursor_after_ingest(s, d):
    e = read.changes_since(_ingested(s, d).events("content"), 0)
    return e.groupBy("sequence", "event_type").agg(F.sum(F.size("node_ids") + F.size("edge_ids")).alias("n"))


@query("WITH D AS (SELECT DISTINCT lower(lang) AS t FROM documents WHERE text IS NOT NULL UNION SELECT lower(source) FROM documents WHERE text IS NOT NULL) SELECT 'concepts_detected' AS kind, string_agg(t, ', ' ORDER BY t) AS detail FROM D")
def content_outbound(s, d):
    return content.outbound(_ingested(s, d).changed["NodesAdded"]).where("kind = 'concepts_detected'")


_JSON = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{\"text\": 5}' WHEN 1 THEN '{\"text\": \"t' || doc_id || '\", \"tags\": [\"A\", 7, \"b\"], \"line\": ' || doc_id || '}' WHEN 2 THEN '{\"file_path\": \"x\"}' ELSE '{\"text\": \"u\", \"line\": \"9\", \"column\": -1}' END AS value FROM documents"


@query(f"WITH V AS ({_JSON}) SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'extract-file' ELSE 'content' END AS kind FROM V")
def classify_inputs(s, d):
    T.views(s, d, _JSON)
    return s.sql(_JSON).select("doc_id", router.classify_column(F.col("value")).alias("kind"))


@query(f"WITH V AS ({_JSON}) SELECT doc_id AS ord, CASE WHEN doc_id % 4 = 1 THEN 'A,b' ELSE '' END AS tags, CASE WHEN doc_id % 4 = 1 THEN doc_id END AS line FROM V WHERE doc_id % 2 = 1")
def content_json(s, d):
    T.views(s, d, _JSON)
    ok, _ = content.parse(s.sql(_JSON).withColumnRenamed("doc_id", "ord"))
    return ok.select("ord", F.array_join("tags", ",").alias("tags"), "line")


@query(f"WITH V AS ({_JSON}) SELECT doc_id AS ord, 'text is required' AS reason FROM V WHERE doc_id % 2 = 0")
def content_rejected(s, d):
    T.views(s, d, _JSON)
    return content.parse(s.sql(_JSON).withColumnRenamed("doc_id", "ord"))[1].select("ord", "reason")


# -- files -------------------------------------------------------------------------------------------------------------
_FILE = "SELECT doc_id, '/in/d' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.MD' WHEN 3 THEN '.yml' ELSE '' END AS path, '---' || chr(10) || 'tags: [' || upper(lang) || ', ' || source || ']' || chr(10) || '---' || chr(10) || '# Doc ' || doc_id || chr(10) || chr(10) || 'See [' || source || '](u).' || chr(10) || chr(10) || '## ' || lang || chr(10) || 'end' || chr(10) AS content FROM documents"


def _files(s, d):
    T.views(s, d, _FILE)
    return s.sql(_FILE).select("path", F.length("content").cast("long").alias("length"), F.encode("content", "UTF-8").alias("content"))


@query(f"SELECT path, CASE doc_id % 5 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'text/plain' WHEN 3 THEN 'text/yaml' ELSE 'application/octet-stream' END AS mime FROM ({_FILE})")
def mime_types(s, d):
    return _files(s, d).select("path", files.mime_type(F.col("path")).alias("mime"))


@query(f"SELECT 'file:' || path AS source, 'concept:' || t AS target FROM (SELECT path, unnest([lower(lang), lower(source)]) AS t FROM ({_FILE}) JOIN documents USING (doc_id))")
def front_matter_tags(s, d):
    return files.registration(_files(s, d)).edges.select("source", "target")


@query(f"SELECT 'file:' || path AS id, 'file' AS node_type FROM ({_FILE}) UNION ALL SELECT 'extraction-status:' || path, 'extraction-status' FROM ({_FILE}) UNION ALL SELECT 'concept:' || t, 'concept' FROM (SELECT lower(lang) AS t FROM documents UNION SELECT lower(source) FROM documents)")
def extract_file_nodes(s, d):
    return files.registration(_files(s, d)).nodes.select("id", "node_type")


@query(f"WITH X AS (SELECT path, lang, source FROM ({_FILE}) JOIN documents USING (doc_id) WHERE path LIKE '%.md') SELECT path, 'Doc ' || path[6:length(path) - 3] AS label, 4::BIGINT AS start_line, 7::BIGINT AS end_line FROM X UNION ALL SELECT path, lang, 8, 9 FROM X UNION ALL SELECT path, 'tags: [' || upper(lang) || ', ' || source || ']', 2, 3 FROM X")
def markdown_sections(s, d):
    """The closing line of a front matter underlines the line before it: to Markdown, that's a heading."""
    x = files.structure(_files(s, d)).select("path", F.explode("sections").alias("s"))
    return x.select("path", "s.label", "s.start_line", "s.end_line")


@query(f"SELECT path, CASE WHEN path LIKE '%.md' THEN lower('tags: [' || lang || ', ' || source || '],doc ') || doc_id || ',' || lower(source) || CASE WHEN lower(lang) = lower(source) THEN '' ELSE ',' || lower(lang) END ELSE '' END AS vocabulary FROM ({_FILE}) JOIN documents USING (doc_id)")
def markdown_vocabulary(s, d):
    return files.structure(_files(s, d)).select("path", F.array_join("vocabulary", ",").alias("vocabulary"))


@query(f"SELECT 'extraction-status:' || path AS id, 'complete' AS structural, CASE WHEN doc_id % 2 = 0 THEN 'complete' ELSE 'skipped: no response' END AS semantic FROM ({_FILE})")
def extraction_status(s, d):
    f = saved(_files(s, d))
    r = f.where("cast(regexp_extract(path, '([0-9]+)', 1) as bigint) % 2 = 0").select("path", F.lit("llm").alias("agent"), F.lit("{}").alias("response"))
    g = empty(s)
    for by, e in files.phases(f, responses=r):
        g = write.apply(g, e, by).graph
        g = Graph(saved(g.nodes), saved(g.edges))
    n = g.nodes.where("node_type = 'extraction-status'")
    return n.select("id", read.text_of("structural_analysis").alias("structural"), read.text_of("semantic_extraction").alias("semantic"))


_ANSWER = "SELECT doc_id, 'p' || doc_id AS path, CASE doc_id % 3 WHEN 0 THEN 'x {\"concepts\": [{\"label\": \"' || upper(lang) || '\", \"confidence\": 0.5}], \"relationships\": [{\"source\": \"' || lang || '\", \"target\": \"' || source || '\", \"weight\": 0.25}]}' WHEN 1 THEN '{\"data\": {\"entities\": [{\"label\": \"' || lang || '\"}], \"cooccurrences\": [{\"entity_a\": \"' || lang || '\", \"entity_b\": \"' || source || '\"}]}}' ELSE '{\"themes\": [{\"description\": \"' || source || '\"}]}' END AS response FROM documents"


@query(f"WITH X AS (SELECT path, doc_id, lower(lang) AS l, lower(source) AS c FROM ({_ANSWER}) JOIN documents USING (doc_id)) SELECT 'file:' || path AS source, 'concept:' || CASE WHEN doc_id % 3 = 2 THEN c ELSE l END AS target, 'tagged_with' AS relationship, 1.0::DOUBLE AS weight FROM X UNION ALL SELECT 'concept:' || l, 'concept:' || c, 'related_to', 0.25 FROM X WHERE doc_id % 3 = 0 UNION ALL SELECT 'concept:' || l, 'concept:' || c, 'may_be_related', 1.0 FROM X WHERE doc_id % 3 = 1 UNION ALL SELECT 'concept:' || c, 'concept:' || l, 'may_be_related', 1.0 FROM X WHERE doc_id % 3 = 1")
def semantic_edges(s, d):
    T.views(s, d, _ANSWER)
    r = s.sql(_ANSWER).select("path", F.lit("a").alias("agent"), "response")
    return semantic.emission(r).edges.where("relationship <> 'contains'").select(*EDGE3, F.element_at("contributions", "extract-semantic:a").alias("weight"))


_UPDATES = "SELECT '{\"updates\": [{\"node_id\": \"customer:' || c_custkey || '\", \"properties\": {\"rank\": ' || c_custkey || ', \"kind\": \"k\", \"list\": [1]}}]}' AS response, CASE WHEN c_custkey % 2 = 0 THEN 'success' ELSE 'failed' END AS status FROM customer"


@query(C("SELECT id, CASE WHEN id LIKE 'customer:%' AND split_part(id, ':', 2)::BIGINT % 2 = 0 THEN split_part(id, ':', 2) || '.0' END AS rank, CASE WHEN id LIKE 'customer:%' AND split_part(id, ':', 2)::BIGINT % 2 = 0 THEN 3 ELSE 1 END AS n FROM N"))
def analysis_updates(s, d):
    g = T.commerce(s, d, False)
    T.views(s, d, _UPDATES)
    n = write.apply(g, analysis.external(s.sql(_UPDATES)), "graph-analysis:x").graph.nodes
    return n.select("id", F.col("properties")["rank"].alias("rank"), F.size("properties").alias("n"))


# -- specs and templates -----------------------------------------------------------------------------------------------
_TALK = "SELECT conv_id, to_json(struct(concat('C', conv_id) AS title, collect_list(struct(turn AS n, upper(role) AS role)) AS turns)) AS value FROM conversations GROUP BY conv_id"
TALK = """
adapter_id: talk
input_kind: talk.thread
input_schema: [{name: title, type: string, required: true}, {name: turns, type: array}]
emit:
  - create_node: {id: "talk:{input.title | lowercase}", type: talk, dimension: structure, properties: {title: "{input.title}"}}
  - for_each:
      collection: input.turns
      variable: turn
      emit:
        - create_node: {id: "concept:{input.turn.role | lowercase}", type: concept, dimension: semantic, properties: {label: "{input.turn.role | lowercase}"}}
        - create_node: {id: {hash: ["{input.title}", "{input.turn.n}"]}, type: turn, dimension: structure, properties: {n: "{input.turn.n}"}}
        - create_edge: {source: "talk:{input.title | lowercase}", target: "concept:{input.turn.role | lowercase}", relationship: has_role, source_dimension: structure, target_dimension: semantic, weight: "{input.turn.n}"}
  - create_provenance: {chain_id: "chain:{adapter_id}:{input.title}", mark_annotation: "{input.title}"}
lens: {consumer: desk, translations: [{from: [has_role], to: involves, min_weight: 0.5}]}
"""


def _talks(s, d):
    T.views(s, d, "conversations")
    return s.sql(_TALK).select(F.col("conv_id").alias("ord"), "value")


_SPEC_NS = "7cb8c920aebe11ef90b400c04fd430c9"


@query(f"SELECT 'talk:c' || conv_id AS id, 'talk' AS node_type FROM conversations GROUP BY conv_id UNION ALL SELECT 'concept:' || lower(role), 'concept' FROM conversations GROUP BY lower(role) UNION ALL SELECT {_uuid5('t', _SPEC_NS)}, 'turn' FROM (SELECT DISTINCT 'C' || conv_id || ':' || turn AS t FROM conversations) UNION ALL SELECT 'chain:talk:C' || conv_id, 'chain' FROM conversations GROUP BY conv_id UNION ALL SELECT 'mark:talk:chain:talk:C' || conv_id, 'mark' FROM conversations GROUP BY conv_id")
def spec_for_each(s, d):
    e, _ = declarative.emission(declarative.parse(TALK), _talks(s, d))
    return write.upsert_nodes(empty(s).nodes, e.nodes).select("id", "node_type")


@query("SELECT 'talk:c' || conv_id AS source, 'concept:' || lower(role) AS target, count(*) AS n, sum(turn)::DOUBLE AS weight FROM conversations GROUP BY conv_id, lower(role)")
def spec_edges(s, d):
    e, _ = declarative.emission(declarative.parse(TALK), _talks(s, d))
    return e.edges.where("relationship = 'has_role'").groupBy("source", "target").agg(F.count("*").alias("n"), F.sum("raw_weight").alias("weight"))


@query("SELECT DISTINCT conv_id AS ord, 'title is required' AS reason FROM conversations WHERE conv_id % 2 = 0")
def spec_rejected(s, d):
    t = _talks(s, d).withColumn("value", F.when(F.col("ord") % 2 == 0, F.regexp_replace("value", '"title"', '"titel"')).otherwise(F.col("value")))
    return declarative.emission(declarative.parse(TALK), t)[1].select("ord", "reason")


@query(C(" SELECT source, target, 'lens:desk:involves' AS relationship FROM E WHERE relationship = 'contains' AND w >= 0.5"))
def spec_lens_sweep(s, d):
    spec = declarative.parse(TALK.replace("[has_role]", "[contains]"))
    return declarative.lens(spec).run(_kept(T.commerce(s, d))).select(EDGE3)


@query("SELECT doc_id, 'Doc-' || lower(lang) || '/' || source || ':' || doc_id AS a, array_to_string(list_sort([lang, source]), '+') AS b, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), 'none') AS c FROM documents")
def template_filters(s, d):
    t = s.read.parquet(f"{d}/documents.parquet")
    blank = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang"))
    v = F.to_json(F.struct("doc_id", "lang", "source", F.array("lang", "source").alias("both"), blank.alias("blank")))
    t = t.select("doc_id", F.parse_json(v).alias("input"))
    scope = templates.Scope("a", "c")
    r = {"a": "Doc-{input.lang | lowercase}/{input.source}:{input.doc_id}", "b": "{input.both | sort | join:+}", "c": "{input.blank | default:none}"}
    return t.select("doc_id", *[templates.render(x, scope).column.alias(k) for k, x in r.items()])


# -- provenance --------------------------------------------------------------------------------------------------------
def _marked(s, d):
    T.views(s, d, "conversations")
    m = s.sql("SELECT 'mark:' || conv_id || ':' || turn AS mark_id, 'chain:' || conv_id AS chain_id, 'f' || (conv_id % 7) AS file, cast(turn AS int) AS line, role AS annotation, array(role) AS tags FROM conversations")
    chains = s.sql("SELECT DISTINCT 'chain:' || conv_id AS id FROM conversations").select("id", F.lit("chain").alias("node_type"), F.lit("provenance").alias("content_type"), F.lit("provenance").alias("dimension"), F.create_map(F.lit("status"), F.lit('"active"')).alias("properties"))
    return write.apply(write.apply(empty(s), Emission(nodes=chains), "provenance").graph, provenance.add_marks(m), "provenance").graph


@query("SELECT DISTINCT role AS tag FROM conversations")
def list_tags(s, d):
    return read.list_tags(_marked(s, d))


@query("SELECT 'mark:' || conv_id || ':' || turn AS id FROM conversations WHERE conv_id % 7 = 3 AND role = 'user'")
def list_marks_filtered(s, d):
    return read.list_marks(_marked(s, d), file="f3", tag="user").select("id")


@query("SELECT 'mark:' || conv_id || ':' || turn AS id FROM conversations WHERE conv_id <> (SELECT min(conv_id) FROM conversations)")
def delete_chain(s, d):
    g = _marked(s, d)
    c = s.table("conversations").agg(F.min("conv_id")).first()[0]
    return write.apply(g, provenance.delete_chain(g, f"chain:{c}"), "provenance").graph.nodes.where("node_type = 'mark'").select("id")


@query("SELECT 'chain:' || min(conv_id) AS id, 'archived' AS status FROM conversations")
def archive_chain(s, d):
    g = _marked(s, d)
    c = s.table("conversations").agg(F.min("conv_id")).first()[0]
    return read.list_chains(write.apply(g, provenance.archive_chain(g, f"chain:{c}"), "provenance").graph, "archived").select("id", "status")


@query("SELECT 'mark:' || conv_id || ':' || turn AS id, CASE WHEN conv_id = (SELECT min(conv_id) FROM conversations) AND turn = (SELECT min(turn) FROM conversations c WHERE c.conv_id = (SELECT min(conv_id) FROM conversations)) THEN 'new' ELSE role END AS annotation FROM conversations")
def update_mark(s, d):
    g = _marked(s, d)
    r = s.table("conversations").agg(F.min(F.struct("conv_id", "turn")).alias("m")).first().m
    g = write.apply(g, provenance.update_mark(g, f"mark:{r.conv_id}:{r.turn}", annotation="new"), "provenance").graph
    return read.list_marks(g).select("id", "annotation")


@query("SELECT 'mark:' || b.conv_id || ':' || b.turn AS id, 'out' AS way FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.conv_id = (SELECT min(conv_id) FROM conversations) AND a.turn = 1 UNION ALL SELECT 'mark:' || b.conv_id || ':' || b.turn, 'in' FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.conv_id = (SELECT min(conv_id) FROM conversations) AND a.turn = 1")
def mark_get_links(s, d):
    g = T.provenance(s, d)
    c = s.table("conversations").agg(F.min("conv_id")).first()[0]
    a, b = read.get_links(g, f"mark:{c}:1")
    return a.select("id", F.lit("out").alias("way")).union(b.select("id", F.lit("in")))


@query(P("SELECT (SELECT count(*) FROM N) AS node_count, (SELECT count(*) FROM E) AS edge_count"))
def context_info(s, d):
    g = T.provenance(s, d)
    return s.createDataFrame([(g.nodes.count(), g.edges.count())], "node_count bigint, edge_count bigint")


# -- reads -------------------------------------------------------------------------------------------------------------
@query(P(", A AS (SELECT source AS id FROM E WHERE target = 'concept:user' AND relationship = 'references') SELECT source, target, relationship FROM E WHERE (target = 'concept:user' AND relationship = 'references') OR (relationship = 'contains' AND target IN (SELECT id FROM A))"))
def evidence_edges(s, d):
    return read.evidence(T.provenance(s, d), "concept:user")[1].select(EDGE3)


@query(C(_bfs("customer:1", 2, OUT) + " SELECT id, (SELECT max(level) FROM L) AS depth FROM L WHERE level > 0", True))
def traverse_all_nodes(s, d):
    levels, _ = read.traverse(T.commerce(s, d, False), "customer:1", 2)
    return read.all_nodes(levels).withColumn("depth", F.lit(read.max_depth(levels)))


@query(C(_bfs("customer:1", 2, OUT) + f", K AS ({_RANK.format(depth=2, v='w').lstrip(', ').replace('X AS', 'WITH X AS', 1)}) SELECT id, level, row_number() OVER (PARTITION BY level ORDER BY score DESC, id)::INT AS pos FROM K", True))
def rank_positions(s, d):
    levels, edges = read.traverse(T.commerce(s, d), "customer:1", 2)
    edges = edges.withColumn("raw_weight", R6("raw_weight"))
    return read.rank(levels, edges).select("id", "level", "pos")


@query(C(_bfs("customer:1", 6, BOTH) + " SELECT level AS edges FROM L WHERE id = 'region:2'", True))
def path_edges(s, d):
    """How many steps of the path are edges of the graph: all of them."""
    g = T.commerce(s, d, False)
    p = read.shortest_path(g, "customer:1", "region:2", 6, "both") or []
    steps = s.createDataFrame([(a["id"], b["id"], b["via"]) for a, b in zip(p, p[1:])], "a string, b string, relationship string")
    e = g.edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "relationship")
    e = e.unionByName(g.edges.select(F.col("target").alias("a"), F.col("source").alias("b"), "relationship"))
    met = e.join(F.broadcast(steps), ["a", "b", "relationship"], "left_semi").distinct()
    return steps.join(met, ["a", "b", "relationship"]).agg(F.count("*").cast("int").alias("edges"))


@query(C("SELECT relationship, a.pval AS source_text, b.pval AS target_text FROM E JOIN N a ON a.id = source JOIN N b ON b.id = target WHERE source = 'nation:3' AND relationship = 'located_in'"))
def explain_texts(s, d):
    g = T.commerce(s, d, False)
    region = g.edges.where("source = 'nation:3' and relationship = 'located_in'").first().target
    return read.explain(g, "nation:3", region).select("relationship", "source_text", "target_text")


@query(C("SELECT source, target, relationship, round(w / max(w) OVER (PARTITION BY source) + 1e-9, 6) AS normalized FROM E"))
def norm_custom(s, d):
    """A normalisation of one's own: a function from edges to edges with ``normalized_weight``."""
    own = lambda e: e.withColumn("normalized_weight", F.col("raw_weight") / F.max("raw_weight").over(read.per_source()))
    return own(T.commerce(s, d).edges).select(*EDGE3, R6("normalized_weight").alias("normalized"))


@query(C("SELECT source, target, relationship, round(w + 1e-9, 6) AS weight FROM E"))
def graph_export_edges(s, d):
    return read.export(T.commerce(s, d))[1].select(*EDGE3, R6("weight").alias("weight"))


@query(G(_CO + " SELECT s AS source, t AS target, 'may_be_related' AS origin FROM Z WHERE w >= 0.5"))
def translated_from(s, d):
    g = _kept(T.tags(s, d))
    g = Graph(g.nodes, saved(enrich.cooccurrence(g)))
    e = enrich.lens(g, "shop", [enrich.Translation(("may_be_related",), "goes_with", 0.5)])
    return e.select("source", "target", F.array_join(read.translated_from(), ",").alias("origin"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def epoch_ms(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    stamp = F.concat(F.lit('"'), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z"'))
    return e.select("event_id", enrich.epoch_ms(stamp).alias("ms"))


# -- writes ------------------------------------------------------------------------------------------------------------
@query(C("SELECT source, target, relationship FROM E WHERE relationship = 'supplied_by'"))
def weights_changed(s, d):
    g = T.commerce(s, d, False)
    twice = g.edges.where("relationship = 'supplied_by'").withColumn("raw_weight", F.col("contributions")["quantity"] * 2)
    return write.weights_changed(g.edges, twice, "quantity").select(EDGE3)


@query(C("SELECT source, target, relationship FROM E WHERE NOT (relationship = 'placed' AND target IN (SELECT id FROM N WHERE pval = 'F' AND node_type = 'order'))"))
def remove_edges(s, d):
    g = T.commerce(s, d, False)
    done = g.nodes.where("node_type = 'order' and properties['status'] = '\"F\"'").select(F.col("id").alias("target"))
    gone = g.edges.where("relationship = 'placed'").join(done, "target", "left_semi")
    return write.apply(g, Emission(edge_removals=gone.select("source", "target", "relationship")), "x").graph.edges.select(EDGE3)


@query(C("SELECT source, target, relationship, CASE WHEN q IS NULL AND r IS NULL THEN 'atlas' WHEN r IS NULL THEN 'quantity' ELSE 'quantity,revenue' END AS contributors FROM E"))
def assign_contribution(s, d):
    e = write.assign_contribution(T.commerce(s, d, False).edges, "atlas")
    return e.select(*EDGE3, F.array_join(F.array_sort(F.map_keys("contributions")), ",").alias("contributors"))


@query(C("SELECT 1::BIGINT AS sequence, 'NodesRemoved' AS event_type, CAST(NULL AS VARCHAR) AS reason, count(*) AS n FROM N WHERE node_type = 'nation' UNION ALL SELECT 2, 'EdgesRemoved', 'cascade', count(*) FROM E WHERE source LIKE 'nation:%' OR target LIKE 'nation:%'"))
def removal_events(s, d):
    g = T.commerce(s, d, False)
    e = write.apply(g, Emission(removals=g.nodes.where("node_type = 'nation'").select("id")), "x").events("x")
    return e.groupBy("sequence", "event_type", "reason").agg(F.sum(F.size("node_ids") + F.size("edge_ids")).alias("n"))


@query(C("SELECT 'ContributionsRetracted' AS event_type, count(*) AS n FROM E WHERE q IS NOT NULL UNION ALL SELECT 'EdgesRemoved', count(*) FROM E WHERE q IS NOT NULL AND r IS NULL"))
def retract_events(s, d):
    e = write.retracted(T.commerce(s, d, False), "quantity").events("quantity")
    return e.groupBy("event_type").agg(F.sum(F.size("edge_ids")).alias("n"))


@query(C("SELECT count(*) AS added, (SELECT count(*) FROM E WHERE target LIKE 'supplier:%' OR source LIKE 'supplier:%') AS rejected FROM E WHERE source NOT LIKE 'supplier:%' AND target NOT LIKE 'supplier:%'"))
def emit_counts(s, d):
    """An emission of the whole graph in two halves, merged, whose suppliers are left out: edges at them are rejected."""
    g = T.commerce(s, d, False)
    half = F.pmod(F.xxhash64("source"), F.lit(2)) == 0
    e = Emission(nodes=g.nodes.where("node_type <> 'supplier'"), edges=g.edges.where(half)).merge(Emission(edges=g.edges.where(~half)))
    n = write.apply(empty(s), e, "x").counts()
    return s.createDataFrame([(n["EdgesAdded"], n["rejected"])], "added bigint, rejected bigint")


# -- vectors -----------------------------------------------------------------------------------------------------------
_NEAR = "WITH V AS (SELECT 'vec:' || vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), X AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 5) AS similarity, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) AS r FROM V a JOIN V b ON a.id <> b.id) SELECT id, other, similarity FROM X WHERE r <= 5 AND similarity >= 0.2"


@query(_NEAR)
def nearest_vectors(s, d):
    """The five nearest of each vector of at least 0.2; the store holds single precision, as the table does."""
    v = s.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("vec:"), "vec_id").alias("id"), "embedding")
    store = vectors.VectorStore()
    store.store(v, "table")
    return store.find_similar(v, "table", 0.2, 5).select("id", "other", F.round("similarity", 5).alias("similarity"))


