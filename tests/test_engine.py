import json

import pytest
from pyspark.sql import functions as F

from skein.adapters import analysis, content, files, provenance, router, semantic
from skein.api import Engine, NotFound
from skein.functions import templates as T
from skein.model import NODE, Graph, edge_id, empty
from skein.operators import enrich, read, vectors, write
from skein.spec import declarative
from skein.store import ParquetStore

LENS = """
adapter_id: trail-content
input_kind: trail.fragment
input_schema:
  - {name: title, type: string, required: true}
  - {name: tags, type: array}
lens:
  consumer: trail
  translations:
    - {from: [may_be_related], to: thematic_connection, min_weight: 0.1}
emit:
  - create_node: {id: "fragment:{input.title | lowercase}", type: fragment, dimension: structure, properties: {title: "{input.title}", n: "{input.n | default:none}"}}
  - for_each:
      collection: input.tags
      variable: tag
      emit:
        - create_node: {id: "concept:{input.tag | lowercase}", type: concept, dimension: semantic, properties: {label: "{input.tag}"}}
        - create_edge: {source: "fragment:{input.title | lowercase}", target: "concept:{input.tag | lowercase}", relationship: tagged_with, source_dimension: structure, target_dimension: semantic, weight: "{input.w}"}
        - update_properties: {node_id: "fragment:{input.title | lowercase}", properties: {last: "{input.tag}"}}
  - create_provenance: {chain_id: "chain:{adapter_id}:{input.title}", mark_annotation: "{input.title}", tags: "{input.tags}"}
"""


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", enrichments=[enrich.co_occurrence(), enrich.gap()])
    e.context_create("lab")
    return e


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_content_of_two_tags(spark, engine):
    done = engine.ingest("lab", {"text": "Walked through Avignon", "tags": ["Travel", "avignon", 7], "line": "x"})
    g = engine.graph("lab")
    kinds = {r.node_type: r["count"] for r in g.nodes.groupBy("node_type").count().collect()}
    assert kinds == {"fragment": 1, "concept": 2, "chain": 1, "mark": 1}
    e = {(r.relationship, r.source_dimension, r.target_dimension) for r in g.edges.collect()}
    assert ("tagged_with", "structure", "semantic") in e and ("contains", "provenance", "provenance") in e and ("may_be_related", "semantic", "semantic") in e
    assert g.edges.where("relationship in ('tagged_with', 'contains')").count() == 3
    assert {(r.kind, r.detail.split(":")[0]) for r in done.outbound.collect()} == {("fragment_indexed", "fragment"), ("concepts_detected", "avignon, travel")}
    assert done.commits[0][1].is_fully_committed() and not done.commits[0][1].is_noop()
    with pytest.raises(ValueError):
        engine.ingest("lab", {"annotation": "no text"})
    with pytest.raises(LookupError):
        engine.ingest("lab", {"text": "x"}, kind="nothing")


def test_cursor_over_ingests(engine):
    engine.ingest("lab", {"text": "one", "tags": ["a", "b"]})
    first, at = engine.changes_since("lab")
    assert [r.event_type for r in first.collect()][:2] == ["NodesAdded", "EdgesAdded"] and at == first.count() == 3
    engine.ingest("lab", {"text": "two", "tags": ["b", "c"]})
    later, end = engine.changes_since("lab", at)
    assert min(r.sequence for r in later.collect()) == at + 1 and end > at
    by, _ = engine.changes_since("lab", 0, adapter_id="co_occurrence:tagged_with:may_be_related")
    assert {r.event_type for r in by.collect()} <= {"EdgesAdded", "WeightsChanged"} and by.count() >= 2
    typed, _ = engine.changes_since("lab", 0, event_types=["NodesAdded"], limit=1)
    assert [r.sequence for r in typed.collect()] == [1]
    none, jump = engine.changes_since("lab", 0, adapter_id="nobody")
    assert none.isEmpty() and jump == end
    g = engine.graph("lab")
    known = {r.i for r in g.edges.select(edge_id(engine.set_context("lab")).alias("i")).collect()}
    assert {x for r in engine.store.events(engine.set_context("lab")).collect() for x in r.edge_ids} <= known
    engine.store.compact_events(engine.set_context("lab"))
    assert engine.changes_since("lab", 0)[1] == end


def test_same_ingest_again_changes_nothing(engine):
    x = [{"text": "one", "tags": ["a", "b"]}, {"text": "two", "tags": ["a"], "chain_name": "Field Notes", "file": "f.md", "line": 3}]
    engine.ingest("lab", x)
    a = engine.graph("lab")
    before = (ids(a.nodes), sorted(tuple(r) for r in a.edges.select("source", "target", "relationship", "raw_weight").collect()))
    engine.ingest("lab", x)
    b = engine.graph("lab")
    assert before == (ids(b.nodes), sorted(tuple(r) for r in b.edges.select("source", "target", "relationship", "raw_weight").collect()))
    m = {r.file: (r.line, r.chain_id) for r in engine.list_marks("lab").collect()}
    assert m["f.md"] == (3, "chain:provenance:field-notes") and m["default"] == (1, "chain:content:default")
    assert ids(engine.list_tags("lab"), "tag") == ["a", "b"]


def test_provenance_life(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", enrichments=[])
    engine.context_create("lab")
    engine.create_chain("lab", "chain:1", "field notes")
    for k in (1, 2):
        engine.add_mark("lab", f"mark:{k}", "chain:1", "src/graph/mod.rs", 42, "an entry", tags=["#graph", "#entry-point"], mark_type="note")
    engine.link_marks("lab", "mark:1", "mark:2")
    assert [ids(x) for x in engine.get_links("lab", "mark:1")] == [["mark:2"], []]
    assert ids(engine.get_chain("lab", "chain:1")[1]) == ["mark:1", "mark:2"] and ids(engine.list_tags("lab"), "tag") == ["#entry-point", "#graph"]
    assert ids(engine.list_marks("lab", tag="#graph", file="src/graph/mod.rs", mark_type="note", chain="chain:1")) == ["mark:1", "mark:2"]
    assert engine.list_marks("lab", tag="graph").isEmpty()
    out = engine.update_mark("lab", "mark:1", annotation="better", line=7)
    assert [r.kind for r in out.outbound.collect()] == ["provenance_updated"]
    m = engine.list_marks("lab").where("id = 'mark:1'").first()
    assert (m.annotation, m.line, m.tags, m.links) == ("better", 7, ["#graph", "#entry-point"], ["mark:2"])
    engine.unlink_marks("lab", "mark:1", "mark:2")
    assert engine.get_links("lab", "mark:1")[0].isEmpty()
    engine.archive_chain("lab", "chain:1")
    assert engine.list_chains("lab", "active").isEmpty() and ids(engine.list_chains("lab", "archived")) == ["chain:1"]
    engine.delete_mark("lab", "mark:2")
    assert ids(engine.get_chain("lab", "chain:1")[1]) == ["mark:1"]
    engine.delete_chain("lab", "chain:1")
    g = engine.graph("lab")
    assert g.nodes.isEmpty() and g.edges.isEmpty()
    reasons = [r.reason for r in engine.changes_since("lab")[0].where("event_type = 'EdgesRemoved'").collect()]
    assert reasons == ["explicit", "cascade", "cascade"]
    for f in (lambda: engine.create_chain("lab", "c", "  "), lambda: engine.delete_chain("lab", "no"), lambda: engine.update_mark("lab", "no"), lambda: engine.link_marks("lab", "a", "b"), lambda: engine.list_chains("lab", "odd")):
        with pytest.raises((ValueError, KeyError)):
            f()


def test_spec_life(engine):
    engine.ingest("lab", {"text": "t", "tags": ["a", "b"]})
    got = engine.load_spec("lab", LENS)
    assert got == {"adapter_id": "trail-content", "lens_namespace": "lens:trail", "vocabulary_edges_created": 2}
    engine.ingest("lab", {"title": "Hills", "tags": ["B", "c"], "w": "0.5", "n": ""}, "trail.fragment")
    g = engine.graph("lab")
    n = {r.id: r for r in g.nodes.collect()}
    p = {k: json.loads(v) for k, v in n["fragment:hills"].properties.items()}
    assert (p["title"], p["n"], p["last"]) == ("Hills", "none", "c") and "created_at" in p
    assert json.loads(n["mark:trail-content:chain:trail-content:Hills"].properties["tags"]) == ["B", "c"]
    assert n["concept:b"].content_type == "concept" and n["fragment:hills"].content_type == "document"
    e = {(r.source, r.target): r.contributions for r in g.edges.where("relationship = 'tagged_with'").collect()}
    assert e["fragment:hills", "concept:c"] == {"trail-content": 0.5}
    lens = g.edges.where("relationship = 'lens:trail:thematic_connection'")
    assert lens.where("source = 'concept:b' and target = 'concept:c'").count() == 1
    other = Engine(engine.spark, engine.store.root, enrichments=[])
    other.sync("lab")
    assert list(other.specs.values())[0].adapter_id == "trail-content"
    before = lens.count()
    engine.unload_spec("lab", "trail-content")
    assert engine.graph("lab").edges.where("relationship like 'lens:%'").count() == before
    with pytest.raises(LookupError):
        engine.ingest("lab", {"title": "x", "tags": [], "w": "1"}, "trail.fragment")
    other.sync("lab")
    assert not other.specs
    with pytest.raises(NotFound):
        engine.unload_spec("lab", "trail-content")
    with pytest.raises(ValueError):
        engine.load_spec("lab", LENS)
        engine.ingest("lab", {"tags": []}, "trail.fragment")


@pytest.mark.parametrize(
    "text, why",
    [
        ("adapter_id: a\ninput_kind: k", "emit"),
        ("adapter_id: a\ninput_kind: k\nemit: [{nonsense: {}}]", "unknown primitive"),
        ("adapter_id: a\ninput_kind: k\nemit: [{create_node: {id: x, type: t, dimension: 'a b'}}]", "whitespace"),
        ("adapter_id: a\ninput_kind: k\nemit: [{create_node: {id: x, type: t, dimension: 'a:b'}}]", "reserved"),
        ("adapter_id: a\ninput_kind: k\nemit: [{create_node: {id: x, type: t, dimension: ''}}]", "empty"),
        ("adapter_id: a\ninput_kind: k\nemit: [{create_provenance: {chain_id: x, mark_annotation: y}}]", "semantic"),
        ("adapter_id: a\ninput_kind: k\nemit: [{create_node: {id: '{input.x | upper}', type: t, dimension: d}}]", "filter"),
        ("adapter_id: a\ninput_kind: k\nemit: [{create_node: {id: '{nothing}', type: t, dimension: d}}]", "accessor"),
        ("adapter_id: a\ninput_kind: k\nemit: [{create_node: {id: '{input.x', type: t, dimension: d}}]", "unclosed"),
        ("adapter_id: a\ninput_kind: k\nenrichments: [{type: odd}]\nemit: []", "enrichment type"),
        ("adapter_id: a\ninput_kind: k\nenrichments: [{type: discovery_gap}]\nemit: []", "requires"),
        ("a: [", "YAML"),
    ],
)
def test_wrong_specs(spark, text, why):
    with pytest.raises(declarative.SpecError, match=why):
        declarative.parse(text)


def test_templates(spark):
    d = spark.createDataFrame([(json.dumps({"s": "AbC", "l": ["b", "a", 3, "c"], "n": 4, "f": 0.5, "t": True, "z": None, "o": {"k": "v", "u": {}}, "e": "", "ll": [["x"], 1]}),)], "value string")
    d = d.select(F.parse_json("value").alias("input"), F.parse_json(F.lit('{"r": [{"q": 1}]}')).alias("ensemble"))
    scope = T.Scope("ad", "ctx", True)
    want = {
        "{input.s | lowercase}!": "abc!",
        "{input.l}": "b,a,3,c",
        "{input.l | sort | join:-}": "a-b-c",
        "{input.l | join}": "b,a,c",
        "{input.n}/{input.f}/{input.t}/{input.z}": "4/0.5/true/",
        "{input.z | default:none}{input.e | default:x}{input.s | default:no}": "nonexAbC",
        "{input.o.k}{adapter_id}{context_id}": "vadctx",
        "{input.ll}": "x,1",
        "no braces": "no braces",
    }
    bad = ["{input.missing}", "{input.o}", "{input.n | lowercase}", "{input.s | sort}", "{input.s | join:,}", "{input.missing | default:x}", "{ensemble.r}", "{input.l.0}"]
    v = {k: T.render(k, scope) for k in [*want, *bad]}
    r = d.select(*[x for k in v for x in (v[k].column.alias(f"c{k}"), v[k].error.alias(f"e{k}"))]).first().asDict()
    assert {k: r[f"c{k}"] for k in want} == want and all(r[f"e{k}"] is None for k in want)
    assert all(r[f"e{k}"] for k in bad)


def test_markdown_and_front_matter():
    text = "# Simple `Document`\nSome [a link](http://x) and ![no](y)\n\n```Rust extra\n# not a heading\n```\nSection *Two*\n===\ntext [Ref][1]\n\n## Three ##\n- item [In List](z)\nlast\n"
    words, sections = files.markdown("p", text)
    assert words == ["simple document", "a link", "rust extra", "section two", "ref", "three", "in list"]
    assert sections == [("Simple Document", 1, 6), ("Section Two", 7, 10), ("Three", 11, 13)]
    assert files.markdown("p", "---\ntags: [a]\n---\n***\n# H\n")[1] == [("tags: [a]", 2, 4), ("H", 5, 5)]
    assert files.markdown("p", "") == ([], []) and files.markdown("p", "plain\ntext") == ([], [])
    m, w = files.front_matter("\n---\ntitle: T\ntags: [Rust, Knowledge-Graph, 3]\n---\n# Head\n")
    assert files.tags_of(m) == ["rust", "knowledge-graph"] and w is None
    assert files.tags_of({"tags": "A, b ,,c"}) == ["a", "b", "c"] and files.tags_of({}) == files.tags_of(None) == []
    assert files.front_matter("---\na: [\n---\n")[1] and files.front_matter("# no") == (None, None)


def test_extract_file(engine, tmp_path):
    (tmp_path / "a.md").write_text("---\ntags: [rust, Testing]\n---\n# Head\ntext\n")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe plain")
    for n in "ab":
        engine.ingest("lab", {"file_path": str(next(tmp_path.glob(f"{n}.*")))})
    n = {r.id: {k: json.loads(v) for k, v in r.properties.items()} for r in engine.graph("lab").nodes.collect()}
    a, b = f"{tmp_path}/a.md", f"{tmp_path}/b.txt"
    assert n[f"file:{a}"]["mime_type"] == "text/markdown" and n[f"file:{b}"]["mime_type"] == "text/plain" and n[f"file:{b}"]["file_size"] == 8
    s = n[f"extraction-status:{a}"]
    assert (s["registration"], s["structural_analysis"], s["semantic_extraction"]) == ("complete", "complete", "skipped: no client")
    assert engine.graph("lab").edges.where("relationship = 'tagged_with'").count() == 2 and "concept:testing" in n


def test_mime_types(spark):
    names = {"x/a.md": "text/markdown", "a.b/c": files.OCTETS, ".md": files.OCTETS, "a.MD": files.OCTETS, "d/e.tar.jpeg": "image/jpeg", "r.rs": "text/x-rust", "x.": files.OCTETS}
    r = spark.createDataFrame([(k,) for k in names], "p string").select("p", files.mime_type(F.col("p")).alias("m")).collect()
    assert {x.p: x.m for x in r} == names


def test_semantic_responses(spark):
    r = [
        ("f.md", "llm", 'Here:\n```json\n{"concepts": [{"label": "Rust", "type": "lang", "confidence": 0.9}, {"name": "Graph"}, {"label": ""}], "relationships": [{"source": "Rust", "target": "Graph", "confidence": 0.4}, {"source": "Rust"}]}\n```'),
        ("f.md", "spacy", json.dumps({"success": True, "data": {"entities": [{"label": "Ada", "type": "PERSON"}], "relationships": [{"source": "Ada", "relationship": "wrote", "target": "Rust"}], "cooccurrences": [{"entity_a": "Ada", "entity_b": "Rust"}]}})),
        ("f.md", "themes", 'x {"themes": [{"description": "Time", "supporting_evidence": "s"}]} y'),
        ("g.md", "llm", "no json"),
        ("h.md", "llm", None),
    ]
    found = spark.createDataFrame([("f.md", [("Head One", 1, 4)])], f"path string, sections {files.SECTIONS}")
    e = semantic.emission(spark.createDataFrame(r, "path string, agent string, response string"), found)
    edges = {(x.source, x.target, x.relationship): x.contributions for x in e.edges.collect()}
    assert edges["concept:rust", "concept:graph", "related_to"] == {"extract-semantic:llm": 0.4}
    assert edges["concept:ada", "concept:rust", "wrote"] == {"extract-semantic:spacy": 1.0} and ("concept:rust", "concept:ada", "may_be_related") in edges
    assert edges["file:f.md", "concept:time", "tagged_with"] == {"extract-semantic:themes": 1.0}
    n = {x.id: x.properties for x in e.nodes.collect()}
    assert json.loads(n["concept:rust"]["confidence"]) == 0.9 and json.loads(n["concept:ada"]["source"]) == "spacy"
    assert json.loads(n["mark:extract-semantic:f.md:head-one"]["tags"]) == ["ada", "graph", "rust", "time"]
    assert "mark:extract-semantic:g.md" in n and "tags" not in n["mark:extract-semantic:g.md"]
    assert semantic.extract_json("[1]") is None and semantic.extract_json("```\n{}\n```") == {}


def test_contexts_and_store(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", enrichments=[])
    e.context_create("a", "first", [{"kind": "file", "path": "x"}])
    with pytest.raises(ValueError):
        e.context_create("a")
    e.context_add_sources("a", [{"kind": "file", "path": "x"}, {"kind": "url", "url": "u"}])
    e.context_remove_sources("a", [{"kind": "file", "path": "x"}])
    e.ingest("a", {"text": "t", "tags": ["q"]})
    e.context_rename("a", "b")
    assert e.context_list() == ["b"] and e.set_context("b") == e._info("b").id
    i = e.context_info("b")
    assert (i["node_count"], i["edge_count"], i["sources"]) == (4, 2, [{"kind": "url", "url": "u"}])
    two = ParquetStore(spark, f"file://{tmp_path}/s")
    base, snap = two.load(i["id"]), two.manifest().contexts[i["id"]].snapshot
    e.ingest("b", {"text": "other", "tags": []})
    assert two.changed()
    removed = write.remove_nodes(base, base.nodes.where("id = 'concept:q'"))
    merged = two.save(i["id"], removed, base, snap)
    left = ids(merged.nodes)
    assert "concept:q" not in left and sum(x.startswith("fragment:") for x in left) == 2
    assert two.vacuum(i["id"]) > 0 and not e.graph("b").nodes.isEmpty()
    e.context_delete("b")
    assert e.context_list() == [] and not e.store.events(i["id"]).isEmpty()
    with pytest.raises(NotFound):
        e.graph("b")


def test_retraction_is_logged(engine):
    engine.ingest("lab", {"text": "t", "tags": ["a", "b"]})
    name = "co_occurrence:tagged_with:may_be_related"
    assert engine.retract_contributions("lab", name) == {"edges_affected": 2, "edges_pruned": 2}
    assert engine.graph("lab").edges.where("relationship = 'may_be_related'").isEmpty()
    log = engine.changes_since("lab")[0].where("reason = 'retraction'").collect()
    assert [r.event_type for r in log] == ["ContributionsRetracted", "EdgesRemoved"] and len(log[0].edge_ids) == 2
    assert engine.retract_contributions("lab", "nobody") == {"edges_affected": 0, "edges_pruned": 0}


def test_updates_of_one_node_are_folded(spark):
    nodes = spark.createDataFrame([("a", "t", "concept", "d", {"x": "1"}), ("b", "t", "concept", "d", {})], NODE)
    ups = spark.createDataFrame([("a", {"x": "2", "y": "3"}, 1), ("a", {"x": "9"}, 2), ("zz", {"x": "1"}, 1)], "id string, properties map<string,string>, ord int")
    r = {x.id: x.properties for x in write.update_properties(nodes, ups).collect()}
    assert r == {"a": {"x": "9", "y": "3"}, "b": {}}
    twice = nodes.where("id = 'a'").union(nodes.where("id = 'a'"))
    assert write.upsert_nodes(nodes, twice).count() == 2


def test_many_contributors_join(spark, monkeypatch):
    e = spark.createDataFrame([("a", "b", "r", "d", "d", {"p": 2.0, "q": -4.0}, 0.0, {}, 1), ("a", "c", "r", "d", "d", {"p": 1.0}, 0.0, {}, 2), ("a", "d", "r", "d", "d", {}, 3.0, {}, 3)], empty(spark).edges.schema)
    want = [(r.target, r.raw_weight) for r in write.recompute_weights(e).orderBy("target").collect()]
    monkeypatch.setattr(write, "MAX_CONTRIBUTORS", 1)
    assert want == [(r.target, r.raw_weight) for r in write.recompute_weights(e).orderBy("target").collect()] == [("b", 0.0), ("c", 0.5), ("d", 3.0)]


def test_vectors(spark, tmp_path):
    table = {"travel": [0.9, 0.3, 0.1], "journey": [0.85, 0.35, 0.15], "voyage": [0.88, 0.32, 0.12], "democracy": [0.1, 0.2, 0.95]}
    embed = vectors.embedder(lambda labels: [table.get(x, [0.0] * 3) for x in labels])
    g = lambda labels: Graph(spark.createDataFrame([(f"concept:{x}", "concept", "concept", "semantic", {"label": json.dumps(x)}) for x in labels], NODE), empty(spark).edges)
    store = vectors.VectorStore(f"file://{tmp_path}/v")
    rule = vectors.similarity("m", embed, store, 0.9)
    first = {(r.source, r.target) for r in rule.run(g(["travel", "journey", "democracy", "unknown"])).collect()}
    assert first == {("concept:travel", "concept:journey"), ("concept:journey", "concept:travel")}
    later = {(r.source, r.target) for r in rule.run(g([*table])).collect()}
    assert later == {(f"concept:{a}", f"concept:{b}") for a, b in [("voyage", "travel"), ("travel", "voyage"), ("voyage", "journey"), ("journey", "voyage")]}
    assert rule.run(g([*table])) is None
    q = store.all(spark, "m").where("id = 'concept:travel'")
    assert [r.other for r in store.find_similar(q, "m", 0.5, 1).collect()] == ["concept:voyage"]
    assert store.has(spark, "m", g(["travel", "new"]).nodes.select("id")).count() == 1

    def fails(labels):
        raise RuntimeError("no model")

    assert vectors.similarity("n", vectors.embedder(fails), store).run(g(["travel"])) is None


def test_analysis(spark):
    nodes = spark.createDataFrame([(x, "n", "document", "d", {}) for x in "abcde"], NODE)
    edges = spark.createDataFrame([(a, b, "r", "d", "d", {}, 1.0, {}, k) for k, (a, b) in enumerate(["ab", "bc", "ca", "de"])], empty(spark).edges.schema)
    g = Graph(nodes, edges)
    got = {r.id: r.community for r in analysis.label_propagation(g).collect()}
    assert got["a"] == got["b"] == got["c"] and got["a"] != got["d"]
    done = write.apply(g, analysis.run(g, "components"), "graph-analysis:components")
    assert {r.id: r.properties["component"] for r in done.graph.nodes.collect()}["e"] == '"d"'
    x = spark.createDataFrame([("a", "success", '{"updates": [{"node_id": "a", "properties": {"rank": 1, "name": "x", "ok": true, "l": [1], "z": null}}]}'), ("b", "failed", '{"updates": [{"node_id": "b", "properties": {"rank": 1}}]}')], "agent string, status string, response string")
    assert [(r.id, r.properties) for r in analysis.external(x).updates.collect()] == [("a", {"rank": "1.0", "name": '"x"', "ok": "true"})]


def test_classify(spark):
    assert [router.classify(x) for x in ({"text": 1}, {"annotation": 1}, {"file_path": 1})] == ["content", "content", "extract-file"]
    with pytest.raises(ValueError):
        router.classify({})
    d = spark.createDataFrame([('{"text":1}',), ('{"file_path":"x"}',), ("{}",)], "v string")
    assert [r.k for r in d.select(router.classify_column(F.col("v")).alias("k")).collect()] == ["content", "extract-file", None]


def test_result_accessors_and_export(spark, tmp_path):
    levels = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, level int")
    assert ids(read.at_depth(levels, 1)) == ["b"] and ids(read.all_nodes(levels)) == ["b", "c"] and read.max_depth(levels) == 2
    nodes = spark.createDataFrame([("a", "n", "document", "d", {"label": '"A"', "text": '"long"'}), ("b", "n", "document", "d", {"label": "5"})], NODE)
    g = Graph(nodes, spark.createDataFrame([("a", "b", "r", "d", "d", {}, 1.0, {}, 1)], empty(spark).edges.schema))
    assert read.write_export(g, f"file://{tmp_path}/x") == {"node_count": 2, "edge_count": 1}
    assert {r.label for r in spark.read.json(f"file://{tmp_path}/x/nodes").collect()} == {"A", "5"}
    r = read.explain(g, "b", "a").first()
    assert (r.direction, r.source_text, r.target_text) == ("reverse", None, "long")
    with pytest.raises(KeyError):
        read.explain(g, "a", "zz")


def test_rounds_follow_triggers(spark):
    seen = []

    def rule(name, out, triggers):
        def run(g):
            seen.append(name)
            return out

        return enrich.Enrichment(name, run, triggers)

    g = Graph(spark.createDataFrame([(x, "n", "document", "d", {}) for x in "ab"], NODE), empty(spark).edges)
    e = spark.createDataFrame([("a", "b", "x", "d", "d", {"r": 1.0}, 1.0, {}, 1)], g.edges.schema)
    once = iter([e, None])
    first = enrich.Enrichment("edges", lambda g: next(once), ("EdgesAdded",))
    out, commits = enrich.run_rounds(g, [first, rule("nodes", None, ("NodesAdded",)), first], {"EdgesAdded"})
    assert out.edges.count() == 1 and [c for c, _ in commits] == ["edges"] and not seen


def test_streams(engine, tmp_path):
    from skein.streaming import changes

    engine.ingest("lab", {"text": "one", "tags": ["a"]})
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text(json.dumps({"text": "streamed", "tags": ["s"]}) + "\n" + json.dumps({"text": "more"}))
    spark = engine.spark
    q = changes.ingest(spark.readStream.schema("value string").text(str(src)), engine, "lab", "content", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert {r.t for r in engine.graph("lab").nodes.where("node_type = 'fragment'").select(read.text_of("text").alias("t")).collect()} == {"one", "streamed", "more"}
    s = changes.changes(spark, engine.store.root, engine.set_context("lab"), 1, event_types=["NodesAdded"])
    w = s.writeStream.format("memory").queryName("seen_changes").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    w.awaitTermination(120)
    got = sorted(r.sequence for r in spark.table("seen_changes").collect())
    want = sorted(r.sequence for r in engine.changes_since("lab", 1, event_types=["NodesAdded"])[0].collect())
    assert got == want and got


def test_provenance_batches(spark):
    m = spark.createDataFrame([("mark:1", "chain:1", "f", 1, "x", ["t"])], "mark_id string, chain_id string, file string, line int, annotation string, tags array<string>")
    e = provenance.add_marks(m)
    assert e.edges.first().relationship == "contains" and e.nodes.first().properties["tags"] == '["t"]'


def test_content_parts(spark):
    added = spark.createDataFrame([("concept:b",), ("concept:a",), ("fragment:1",), ("mark:1",)], "id string")
    assert {tuple(r) for r in content.outbound(added).collect()} == {("fragment_indexed", "fragment:1"), ("concepts_detected", "a, b")}


def test_tools(engine):
    from skein.tools import Tools

    t = Tools(engine)
    assert len(t.names()) == 18 and "error" in t.call("list_tags") and "error" in t.call("nothing")
    assert t.call("set_context", name="lab")["name"] == "lab"
    done = t.call("ingest", data={"text": "one", "tags": ["a", "b"]})
    assert {e["kind"] for e in done["events"]} == {"fragment_indexed", "concepts_detected"} and done["commits"][0]["EdgesAdded"] == 3
    assert t.call("list_tags") == {"tags": ["a", "b"]}
    assert t.call("find_nodes", node_type="concept", limit=1)["rows"][0]["total_count"] == 2
    path = t.call("find_path", source="concept:a", target="concept:b")
    assert path["found"] and path["length"] == 1
    ranked = t.call("traverse", origin="concept:a", rank_by="raw_weight", relationship_prefix="may")
    assert [r["id"] for r in ranked["levels"]["rows"]] == ["concept:a", "concept:b"]
    assert t.call("changes_since", limit=1)["latest_sequence"] == 1
    assert t.call("explain_edge", source="concept:a", target="nobody")["error"].startswith("no such node")
