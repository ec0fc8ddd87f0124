"""Responses of external extractors turned into concepts and relationships.

A response is text with a JSON object in it. By its shape it holds entities with subject-verb-object triples and
co-occurrences, themes, or concepts with relationships. Each agent's contributions are kept apart
(``extract-semantic:{agent}``), and every file gets a chain with a mark for each section.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import edge, js, node, props
from ..operators.write import Emission

ADAPTER = KIND = "extract-semantic"
#: Characters of a file's content that are sent to an extractor.
MOST_CONTENT = 24_000


class Client(Protocol):
    """An external ensemble of agents: it is asked with a JSON text and answers with a text for each agent."""

    def is_available(self) -> bool: ...

    def invoke(self, ensemble: str, payload: str) -> dict[str, str]: ...


class MockClient:
    """Answers from a table of ensembles; ``None`` is a service that doesn't run."""

    def __init__(self, answers: dict[str, dict[str, str]] | None):
        self.answers, self.asked = answers, []

    def is_available(self) -> bool:
        return self.answers is not None

    def invoke(self, ensemble: str, payload: str) -> dict[str, str]:
        self.asked.append((ensemble, payload))
        return (self.answers or {}).get(ensemble, {})


def payload(path: str, content: str, sections: list[dict], vocabulary: list[str]) -> str:
    return json.dumps({"file_path": path, "content": content[:MOST_CONTENT], "sections": sections, "vocabulary": vocabulary})


def extract_json(text: str) -> dict | None:
    """The JSON object of a text: all of it, a fenced block, or from the first brace to the last."""
    t = text.strip()
    tries = [t]
    for mark in ("```json", "```\n"):
        if mark in t:
            body, close, _ = t.split(mark, 1)[1].partition("```")
            tries += [body.strip()] if close else []
            break
    if "{" in t and "}" in t:
        tries.append(t[t.index("{") : t.rindex("}") + 1])
    for x in tries:
        try:
            v = json.loads(x)
        except ValueError:
            continue
        if isinstance(v, dict):
            return v
    return None


def _str(d: object, *keys: str) -> str:
    for k in keys:
        if isinstance(d, dict) and k in d:
            return d[k] if isinstance(d[k], str) else ""
    return ""


def _list(d: dict, key: str) -> list:
    return d[key] if isinstance(d.get(key), list) else []


def _number(d: object, *keys: str) -> float | None:
    for k in keys:
        if isinstance(d, dict) and k in d:
            v = d[k]
            return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    return None


def facts(v: dict) -> Iterator[tuple]:
    """(kind, a, b, relationship, weight, properties): concepts (a: label) and edges between labels a and b."""
    data = v["data"] if "data" in v else v
    if "entities" in v or isinstance(data, dict) and "entities" in data:
        data = data if isinstance(data, dict) else {}
        for e in _list(data, "entities"):
            if label := _str(e, "label"):
                yield "concept", label, None, None, None, {"concept_type": _str(e, "type") or None, "source": "spacy"}
        for r in _list(data, "relationships"):
            if _str(r, "source") and _str(r, "target"):
                yield "edge", r["source"], r["target"], _str(r, "relationship") or "related_to", 1.0, {}
        for c in _list(data, "cooccurrences"):
            if _str(c, "entity_a") and _str(c, "entity_b"):
                yield "edge", c["entity_a"], c["entity_b"], "may_be_related", 1.0, {}
                yield "edge", c["entity_b"], c["entity_a"], "may_be_related", 1.0, {}
    elif "themes" in v and "concepts" not in v and "relationships" not in v:
        for t in _list(v, "themes"):
            if label := _str(t, "description"):
                yield "concept", label, None, None, None, {"source": "theme", "concept_type": _str(t, "type") or None, "evidence": _str(t, "supporting_evidence") or None}
    else:
        for c in _list(v, "concepts"):
            if label := _str(c, "label", "name"):
                yield "concept", label, None, None, None, {"concept_type": _str(c, "type") or None, "confidence": _number(c, "confidence")}
        for r in _list(v, "relationships"):
            if _str(r, "source") and _str(r, "target"):
                w = _number(r, "weight", "confidence")
                yield "edge", r["source"], r["target"], _str(r, "relationship") or "related_to", 1.0 if w is None else w, {}


FACT = "path string, agent string, ord bigint, kind string, a string, b string, relationship string, weight double, properties map<string,string>"
FACT_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.map_(pa.string(), pa.string())]


def parsed(responses: DataFrame) -> DataFrame:
    """The facts of responses (path, agent, response). Texts without a JSON object, and nulls, have none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, agent, text in zip(*(c.to_pylist() for c in b.columns)):
                v = extract_json(text) if text is not None else None
                for k, (kind, a, c, r, w, p) in enumerate(facts(v) if v else ()):
                    out.append((path, agent, k, kind, a, c, r, w, [(x, json.dumps(y)) for x, y in p.items() if y is not None]))
            cols = zip(*out) if out else [()] * len(FACT_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, FACT_TYPES)], [x.split()[0] for x in FACT.split(", ")])

    return responses.select("path", "agent", "response").mapInArrow(run, FACT)


def emission(responses: DataFrame, structure: DataFrame | None = None) -> Emission:
    """Concepts tagged to their file, relationships, and a chain with marks for each file: one for each of its sections
    (``structure``: path, sections), one for the whole file where it has none. Marks carry the file's concept labels."""
    f = parsed(responses)
    key = F.concat(F.lit(f"{ADAPTER}:"), "agent")
    given = lambda w: F.create_map(key, w)
    cid = lambda c: F.concat(F.lit("concept:"), F.lower(c))
    c, e = f.where("kind = 'concept'"), f.where("kind = 'edge'")
    label = F.create_map(F.lit("label"), js(F.lower("a")))
    nodes = c.select(*node(cid("a"), "concept", "concept", "semantic", F.map_concat(label, F.map_filter("properties", lambda k, _: k != "label"))), "ord")
    edges = c.select(*edge(F.concat(F.lit("file:"), "path"), cid("a"), "tagged_with", "structure", "semantic", F.col("ord"), contributions=given(F.lit(1.0))))
    edges = edges.unionByName(e.select(*edge(cid("a"), cid("b"), F.col("relationship"), "semantic", "semantic", F.col("ord"), F.col("weight"), given(F.col("weight")))))
    chain = F.concat(F.lit(f"chain:{ADAPTER}:"), "path")
    paths = responses.select("path").distinct()
    nodes = nodes.unionByName(paths.select(*node(chain, "chain", "provenance", "provenance", props(name=F.concat(F.lit(f"{ADAPTER} — "), "path"), status=F.lit("active"))), F.lit(0).cast("bigint").alias("ord")))
    labels = c.groupBy("path").agg(F.array_sort(F.collect_set(F.lower("a"))).alias("tags"))
    m = paths.join(labels, "path", "left")
    if structure is not None:
        m = m.join(structure.select("path", F.explode("sections").alias("s")), "path", "left")
    else:
        m = m.withColumn("s", F.lit(None).cast("struct<label: string, start_line: bigint, end_line: bigint>"))
    whole = F.col("s").isNull()
    mark = F.concat(F.lit(f"mark:{ADAPTER}:"), "path", F.when(whole, "").otherwise(F.concat(F.lit(":"), F.replace(F.lower("s.label"), F.lit(" "), F.lit("-")))))
    note = F.concat(F.lit("semantic extraction of "), "path", F.when(whole, "").otherwise(F.concat(F.lit(" ["), "s.label", F.lit("]"))))
    p = props(file_path=F.col("path"), section=F.col("s.label"), start_line=F.col("s.start_line"), end_line=F.col("s.end_line"), annotation=note, tags=F.col("tags"))
    nodes = nodes.unionByName(m.select(*node(mark, "mark", "provenance", "provenance", p), F.coalesce("s.start_line", F.lit(0)).cast("bigint").alias("ord")))
    edges = edges.unionByName(m.select(*edge(chain, mark, "contains", "provenance", "provenance", F.coalesce("s.start_line", F.lit(0)), contributions=F.create_map(F.lit(ADAPTER), F.lit(1.0)))))
    return Emission(nodes=nodes, edges=edges)
