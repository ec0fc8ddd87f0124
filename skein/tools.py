"""The engine's methods as tools with JSON parameters and results, for any transport that calls tools by name."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from .api import Engine
from .operators.filters import EdgeFilter

#: Rows of a frame that a tool returns when no limit is given; the rest is counted in ``more``.
PAGE = 1_000


def _filter(p: dict) -> EdgeFilter | None:
    keys = {"contributor_ids": "contributors", "relationship_prefix": "prefix", "min_corroboration": "min_corroboration"}
    given = {to: p[k] for k, to in keys.items() if p.get(k) is not None}
    return EdgeFilter(**given) if given else None


def _rows(df: DataFrame, limit: int = PAGE) -> dict:
    rows = [json.loads(x) for x in df.limit(limit).toJSON().collect()]
    return {"rows": rows, "more": max(0, df.count() - limit) if len(rows) == limit else 0}


class Tools:
    """A context is chosen first (``set_context``, which makes it if there is none); the other tools refer to it unless they
    name one."""

    def __init__(self, engine: Engine):
        self.engine, self.context = engine, None

    def names(self) -> list[str]:
        return sorted(n[2:] for n in dir(self) if n.startswith("t_"))

    def call(self, name: str, /, **p) -> dict:
        """The result of a tool, or what went wrong as ``error``."""
        f: Callable | None = getattr(self, f"t_{name}", None)
        if f is None:
            return {"error": f"unknown tool: {name}"}
        try:
            return f(p)
        except (KeyError, ValueError, LookupError, RuntimeError) as e:
            return {"error": str(e.args[0] if e.args else e)}

    def at(self, p: dict) -> str:
        if (name := p.get("context") or self.context) is None:
            raise ValueError("no context: call set_context first")
        return name

    def t_set_context(self, p):
        id = self.engine.set_context(p["name"])
        self.context = p["name"]
        return {"id": id, "name": self.context}

    def t_ingest(self, p):
        out = self.engine.ingest(self.at(p), p["data"], p.get("input_kind"))
        sent = [] if out.outbound is None else [{"kind": r.kind, "detail": r.detail} for r in out.outbound.limit(PAGE).collect()]
        return {"events": sent, "commits": [{"contributor": c, **r.counts()} for c, r in out.commits]}

    def t_context_list(self, p):
        return {"contexts": self.engine.context_list_info()}

    def t_context_create(self, p):
        return {"id": self.engine.context_create(p["name"], p.get("description", ""))}

    def t_context_delete(self, p):
        self.engine.context_delete(p["name"])
        return {"deleted": p["name"]}

    def t_context_rename(self, p):
        self.engine.context_rename(p["old_name"], p["new_name"])
        return {"renamed": p["new_name"]}

    def t_context_add_sources(self, p):
        self.engine.context_add_sources(p["name"], p["sources"])
        return {"sources": self.engine.context_info(p["name"])["sources"]}

    def t_context_remove_sources(self, p):
        self.engine.context_remove_sources(p["name"], p["sources"])
        return {"sources": self.engine.context_info(p["name"])["sources"]}

    def t_evidence_trail(self, p):
        nodes, edges = self.engine.evidence_trail(self.at(p), p["node_id"], _filter(p))
        return {"nodes": _rows(nodes), "edges": _rows(edges)}

    def t_find_nodes(self, p):
        by = {k: p[k] for k in ("node_type", "dimension", "limit", "offset") if p.get(k) is not None}
        return _rows(self.engine.find_nodes(self.at(p), edge_filter=_filter(p), total=True, **by))

    def t_traverse(self, p):
        levels, edges = self.engine.traverse(self.at(p), p["origin"], depth=p.get("max_depth", 1), direction=p.get("direction", "outgoing"), edge_filter=_filter(p))
        if p.get("rank_by"):
            levels = self.engine.rank_traversal(self.at(p), levels, edges, by=p["rank_by"]).orderBy("level", "pos")
        return {"levels": _rows(levels), "edges": _rows(edges)}

    def t_find_path(self, p):
        path = self.engine.find_path(self.at(p), p["source"], p["target"], max_length=p.get("max_length", 5), direction=p.get("direction", "outgoing"), relationship=p.get("relationship"), edge_filter=_filter(p))
        return {"found": path is not None, "path": path or [], "length": len(path) - 1 if path else 0}

    def t_changes_since(self, p):
        e, at = self.engine.changes_since(self.at(p), p.get("cursor", 0), p.get("adapter_id"), p.get("event_types") or (), p.get("limit"))
        return {"events": _rows(e), "latest_sequence": at}

    def t_list_tags(self, p):
        return {"tags": [r.tag for r in self.engine.list_tags(self.at(p)).limit(PAGE).collect()]}

    def t_shared_concepts(self, p):
        return _rows(self.engine.shared_concepts(p["context_a"], p["context_b"]))

    def t_explain_edge(self, p):
        return _rows(self.engine.explain_edge(self.at(p), p["source"], p["target"], p.get("relationship")))

    def t_load_spec(self, p):
        return self.engine.load_spec(self.at(p), p["spec_yaml"])

    def t_unload_spec(self, p):
        self.engine.unload_spec(self.at(p), p["adapter_id"])
        return {"unloaded": p["adapter_id"]}
