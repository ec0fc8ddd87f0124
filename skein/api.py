"""The engine: contexts, ingest with routing and enrichments, queries by context name, specs, provenance, cursors."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import content, files, provenance, router, semantic
from .model import Graph, saved
from .operators import enrich, read, write
from .operators.filters import EdgeFilter
from .operators.write import Emission, Result
from .spec import declarative
from .store import ContextInfo, ParquetStore, stamp


@dataclass
class Adapter:
    """``process`` gives (contributor, emission) pairs, in order, and a frame of rejected inputs or None; ``outbound`` turns
    logged events of a commit into (kind, detail)."""

    id: str
    kind: str
    process: Callable[[DataFrame, Graph, str], tuple[list[tuple[str, Emission]], DataFrame | None]]
    outbound: Callable[[DataFrame, Graph], DataFrame] | None = None


@dataclass
class Ingest:
    """What an ingest did: a result for each commit, those of the enrichments last; rejected inputs; events that go out."""

    graph: Graph
    commits: list[tuple[str, Result]] = field(default_factory=list)
    rejected: DataFrame | None = None
    outbound: DataFrame | None = None


class Skipped(RuntimeError):
    """An adapter's external service isn't there."""


class NotFound(KeyError):
    pass


def _content(raw: DataFrame, g: Graph, context: str):
    inputs, bad = content.parse(raw) if raw.columns in (["value"], ["value", "ord"]) else (raw, None)
    return [("content", content.emission(inputs))], bad


def _ids(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind).select(F.explode("node_ids").alias("id"))


class Engine:
    """All methods take a context's name. ``embed`` (see ``operators.vectors.embedder``) adds embedding similarity."""

    def __init__(self, spark: SparkSession, root: str, enrichments: Sequence[enrich.Enrichment] | None = None, client: semantic.Client | None = None, embed=None, modules: Sequence[files.Module] = (files.MARKDOWN,)):
        self.spark, self.store, self.client, self.embed, self.modules = spark, ParquetStore(spark, root), client, embed, modules
        self.base = list(enrich.default_enrichments() if enrichments is None else enrichments)
        if embed is not None:
            from .operators import vectors

            self.base.append(vectors.similarity("default", embed, vectors.VectorStore(f"{root}/vectors")))
        self.adapters = [
            Adapter("content", content.KIND, _content, lambda e, g: content.outbound(_ids(e.where("adapter_id = 'content'"), "NodesAdded"))),
            Adapter("extract-file", files.KIND, self._files),
        ]
        self.specs: dict[tuple[str, str], declarative.Spec] = {}
        self.cancelled: set[str] = set()

    # -- contexts --------------------------------------------------------------------------------------------------
    def _info(self, name: str) -> ContextInfo:
        for c in self.store.manifest().contexts.values():
            if c.name == name:
                return c
        raise NotFound(f"context not found: {name}")

    def graph(self, context: str) -> Graph:
        return self.store.load(self._info(context).id)

    def context_create(self, name: str, description: str = "", sources: Sequence[dict] = ()) -> str:
        new = ContextInfo(uuid.uuid4().hex, name, description, sources=list(sources), created_at=stamp(), updated_at=stamp())

        def edit(m):
            if any(c.name == name for c in m.contexts.values()):
                raise ValueError(f"context exists: {name}")
            m.contexts[new.id] = new

        self.store.change(edit)
        return new.id

    def set_context(self, name: str) -> str:
        """The id of a context, which is made if there is none."""
        try:
            return self._info(name).id
        except NotFound:
            return self.context_create(name)

    def _edit(self, name: str, f: Callable[[ContextInfo], None]) -> None:
        id = self._info(name).id

        def edit(m):
            f(m.contexts[id])
            m.contexts[id].updated_at = stamp()

        self.store.change(edit)

    def context_rename(self, name: str, new: str) -> None:
        id = self._info(name).id

        def edit(m):
            if any(c.name == new and c.id != id for c in m.contexts.values()):
                raise ValueError(f"context exists: {new}")
            m.contexts[id].name = new

        self.store.change(edit)

    def context_delete(self, name: str) -> None:
        """Nodes and edges go; events and specs stay."""
        id = self._info(name).id
        self.store.change(lambda m: m.contexts.pop(id))
        self.store.vacuum(id)

    def context_update(self, name: str, **metadata) -> None:
        self._edit(name, lambda c: [setattr(c, k, v) for k, v in metadata.items() if k in ("description", "owner", "tags", "properties")])

    def context_add_sources(self, name: str, sources: Sequence[dict]) -> None:
        self._edit(name, lambda c: c.sources.extend(s for s in sources if s not in c.sources))

    def context_remove_sources(self, name: str, sources: Sequence[dict]) -> None:
        self._edit(name, lambda c: setattr(c, "sources", [s for s in c.sources if s not in sources]))

    def context_list(self) -> list[str]:
        return sorted(c.name for c in self.store.manifest().contexts.values())

    def context_info(self, name: str) -> dict:
        c, g = self._info(name), self.graph(name)
        return {"id": c.id, "name": c.name, "description": c.description, "sources": c.sources, "node_count": g.nodes.count(), "edge_count": g.edges.count()}

    def context_list_info(self) -> list[dict]:
        return [self.context_info(n) for n in self.context_list()]

    # -- ingest ----------------------------------------------------------------------------------------------------
    def register(self, adapter: Adapter) -> None:
        self.adapters.append(adapter)

    def frame(self, data) -> DataFrame:
        """Inputs as rows (value, ord): of a DataFrame as it is, else of a JSON object or a list of them."""
        if isinstance(data, DataFrame):
            return data
        rows = [(json.dumps(d), k) for k, d in enumerate(data if isinstance(data, list) else [data])]
        return self.spark.createDataFrame(rows, "value string, ord bigint")

    def ingest(self, context: str, data, kind: str | None = None, enrich_after: bool = True) -> Ingest:
        """Route inputs of a kind to all its adapters, commit what they emit, run the enrichments. The kind of a JSON
        object is told by its fields if not given. The first adapter that fails ends the ingest; commits before it stay."""
        if kind is None:
            kind = router.classify(data[0] if isinstance(data, list) else data)
        self.sync(context)
        info = self._info(context)
        own = [self._declared(s) for (c, _), s in self.specs.items() if c == info.id]
        out, raw = Ingest(self.store.load(info.id)), self.frame(data)
        for a in router.matching([*self.adapters, *own], kind):
            emissions, bad = a.process(raw, out.graph, info.id)
            out.rejected = bad if out.rejected is None else out.rejected
            if not isinstance(data, DataFrame) and bad is not None and (first := bad.first()):
                raise ValueError(first.reason)
            for contributor, e in emissions:
                self._check(context)
                self.commit(info.id, out, contributor, e, a)
        if enrich_after:
            self._enrich(info.id, out)
        return out

    def ingest_with_adapter(self, context: str, adapter_id: str, emission: Emission) -> Ingest:
        """Commit a ready emission in an adapter's name, then run the enrichments."""
        info = self._info(context)
        out = Ingest(self.store.load(info.id))
        self.commit(info.id, out, adapter_id, emission)
        self._enrich(info.id, out)
        return out

    def commit(self, context_id: str, out: Ingest, contributor: str, e: Emission, adapter: Adapter | None = None) -> Result:
        base, before = out.graph, self.store.manifest().contexts[context_id].snapshot
        r = write.apply(base, e, contributor)
        r.settle()
        out.commits.append((contributor, r))
        if r.is_noop():
            return r
        out.graph = r.graph = self.store.save(context_id, r.graph, base, before)
        logged = self.store.append(context_id, contributor, r)
        if adapter is not None and adapter.outbound is not None and logged is not None:
            sent = adapter.outbound(logged, out.graph)
            out.outbound = sent if out.outbound is None else out.outbound.unionByName(sent)
        return r

    def _enrich(self, context_id: str, out: Ingest) -> None:
        kinds = {k for _, r in out.commits for k, n in (r.sizes or {}).items() if n}
        if not kinds:
            return
        base, before = out.graph, self.store.manifest().contexts[context_id].snapshot
        g, commits = enrich.run_rounds(base, self.enrichments(context_id), kinds)
        if commits:
            out.graph = self.store.save(context_id, g, base, before)
            for name, r in commits:
                self.store.append(context_id, name, r)
            out.commits += commits

    def enrichments(self, context_id: str) -> list[enrich.Enrichment]:
        """The engine's, then those and the lenses of the context's specs."""
        specs = [s for (c, _), s in self.specs.items() if c == context_id]
        own = [e for s in specs for e in declarative.enrichments(s, self.embed)]
        return [*self.base, *own, *[x for s in specs if (x := declarative.lens(s))]]

    def _files(self, raw: DataFrame, g: Graph, context: str):
        found = raw if "content" in raw.columns else self._binary(raw)
        return list(files.phases(found, self.modules)), None

    def _binary(self, raw: DataFrame) -> DataFrame:
        paths = [r.p for r in raw.select(F.get_json_object("value", "$.file_path").alias("p")).collect()]
        if None in paths:
            raise ValueError("file_path is required")
        return self.spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", "content")

    def _declared(self, s: declarative.Spec) -> Adapter:
        def process(raw, g, context):
            if s.ensemble is not None:
                if self.client is None or not self.client.is_available():
                    raise Skipped("ensemble declared but no client available")
                answers = [(r.value, r.ord, declarative.answer_of(self.client.invoke(s.ensemble, r.value))) for r in raw.collect()]
                raw = self.spark.createDataFrame(answers, "value string, ord bigint, ensemble string")
            e, bad = declarative.emission(s, raw, context)
            return [(s.adapter_id, e)], bad

        return Adapter(s.adapter_id, s.input_kind, process, lambda e, g: declarative.outbound(e, g, s.adapter_id))

    def cancel(self, context: str) -> None:
        """Ask running ingests of a context to stop before their next commit, and Spark to cancel their jobs."""
        self.cancelled.add(context)
        self.spark.sparkContext.cancelJobGroup(f"ingest:{context}")

    def _check(self, context: str) -> None:
        if context in self.cancelled:
            self.cancelled.discard(context)
            raise InterruptedError(f"ingest into {context} was cancelled")

    # -- specs -----------------------------------------------------------------------------------------------------
    def load_spec(self, context: str, text: str) -> dict:
        """Validate, register and keep a spec, then translate the edges that are there by its lens."""
        spec, info = declarative.parse(text), self._info(context)
        declarative.enrichments(spec, self.embed)
        self.specs[info.id, spec.adapter_id] = spec
        row = {"context_id": info.id, "adapter_id": spec.adapter_id, "spec_yaml": text, "loaded_at": stamp()}
        same = lambda r: (r["context_id"], r["adapter_id"]) == (info.id, spec.adapter_id)
        self.store.change(lambda m: setattr(m, "specs", [*[r for r in m.specs if not same(r)], row]))
        n, lens = 0, declarative.lens(spec)
        if lens is not None:
            out = Ingest(self.store.load(info.id))
            found = saved(lens.run(out.graph))
            if n := found.count():
                self.commit(info.id, out, lens.id, Emission(edges=found))
        return {"adapter_id": spec.adapter_id, "lens_namespace": declarative.namespace(spec), "vocabulary_edges_created": n}

    def unload_spec(self, context: str, adapter_id: str) -> None:
        """The adapter, its enrichments and its lens go; the lens's edges stay."""
        info = self._info(context)
        self.sync(context)
        if (info.id, adapter_id) not in self.specs:
            raise NotFound(f"spec not loaded: {adapter_id}")
        del self.specs[info.id, adapter_id]
        self.store.change(lambda m: setattr(m, "specs", [r for r in m.specs if (r["context_id"], r["adapter_id"]) != (info.id, adapter_id)]))

    def sync(self, context: str) -> None:
        """Take over specs that other processes have loaded or unloaded."""
        id = self._info(context).id
        kept = {r["adapter_id"]: r["spec_yaml"] for r in self.store.manifest().specs if r["context_id"] == id}
        for key in [k for k in self.specs if k[0] == id and k[1] not in kept]:
            del self.specs[key]
        for name, text in kept.items():
            if (id, name) not in self.specs or self.specs[id, name].text != text:
                self.specs[id, name] = declarative.parse(text)

    # -- retraction, changes ---------------------------------------------------------------------------------------
    def retract_contributions(self, context: str, adapter_id: str) -> dict[str, int]:
        info = self._info(context)
        base, before = self.store.load(info.id), info.snapshot
        r = write.retracted(base, adapter_id)
        n = r.counts()
        if n["ContributionsRetracted"]:
            self.store.save(info.id, r.graph, base, before)
            self.store.append(info.id, adapter_id, r)
        return {"edges_affected": n["ContributionsRetracted"], "edges_pruned": n["EdgesPruned"]}

    def changes_since(self, context: str, cursor: int = 0, adapter_id: str | None = None, event_types: Sequence[str] = (), limit: int | None = None) -> tuple[DataFrame, int]:
        """(events after the cursor, cursor to go on from)."""
        e = self.store.events(self._info(context).id)
        changes = read.changes_since(e, cursor, adapter_id, event_types, limit)
        return changes, read.latest_sequence(e, changes, cursor)

    # -- provenance ------------------------------------------------------------------------------------------------
    def _prov(self, context: str, e: Emission) -> Ingest:
        info = self._info(context)
        out = Ingest(self.store.load(info.id))
        self.commit(info.id, out, provenance.ADAPTER, e, Adapter(provenance.ADAPTER, provenance.KIND, None, lambda ev, g: provenance.outbound(ev)))
        self._enrich(info.id, out)
        return out

    def create_chain(self, context: str, chain_id: str, name: str, description: str | None = None) -> Ingest:
        return self._prov(context, provenance.create_chain(self.spark, chain_id, name, description))

    def add_mark(self, context: str, mark_id: str, chain_id: str, file: str, line: int, annotation: str, **more) -> Ingest:
        return self._prov(context, provenance.add_mark(self.spark, mark_id, chain_id, file, line, annotation, **more))

    def link_marks(self, context: str, source: str, target: str) -> Ingest:
        return self._prov(context, provenance.link_marks(self.graph(context), source, target))

    def unlink_marks(self, context: str, source: str, target: str) -> Ingest:
        return self._prov(context, provenance.unlink_marks(self.spark, source, target))

    def delete_mark(self, context: str, mark: str) -> Ingest:
        return self._prov(context, provenance.delete_mark(self.spark, mark))

    def delete_chain(self, context: str, chain: str) -> Ingest:
        return self._prov(context, provenance.delete_chain(self.graph(context), chain))

    def update_mark(self, context: str, mark: str, **values) -> Ingest:
        return self._prov(context, provenance.update_mark(self.graph(context), mark, **values))

    def archive_chain(self, context: str, chain: str) -> Ingest:
        return self._prov(context, provenance.archive_chain(self.graph(context), chain))

    def list_chains(self, context: str, status: str | None = None) -> DataFrame:
        return read.list_chains(self.graph(context), status)

    def get_chain(self, context: str, chain: str) -> tuple[DataFrame, DataFrame]:
        return read.get_chain(self.graph(context), chain)

    def list_marks(self, context: str, **by) -> DataFrame:
        return read.list_marks(self.graph(context), **by)

    def list_tags(self, context: str) -> DataFrame:
        return read.list_tags(self.graph(context))

    def get_links(self, context: str, mark: str) -> tuple[DataFrame, DataFrame]:
        return read.get_links(self.graph(context), mark)

    # -- queries ---------------------------------------------------------------------------------------------------
    def find_nodes(self, context: str, **by) -> DataFrame:
        return read.find(self.graph(context), **by)

    def traverse(self, context: str, origin: str, **how) -> tuple[DataFrame, DataFrame]:
        return read.traverse(self.graph(context), origin, **how)

    def rank_traversal(self, context: str, levels: DataFrame, edges: DataFrame, **how) -> DataFrame:
        return read.rank(levels, edges, all_edges=self.graph(context).edges, **how)

    def find_path(self, context: str, source: str, target: str, **how) -> list[dict] | None:
        return read.shortest_path(self.graph(context), source, target, **how)

    def evidence_trail(self, context: str, concept: str, edge_filter: EdgeFilter | None = None) -> tuple[DataFrame, DataFrame]:
        return read.evidence(self.graph(context), concept, edge_filter)

    def explain_edge(self, context: str, a: str, b: str, relationship: str | None = None) -> DataFrame:
        return read.explain(self.graph(context), a, b, relationship)

    def shared_concepts(self, a: str, b: str) -> DataFrame:
        return read.shared_concepts(self.graph(a), self.graph(b))

    def export_graph(self, context: str, path: str) -> dict[str, int]:
        return read.write_export(self.graph(context), path)

    def analyze(self, context: str, algorithm: str) -> Ingest:
        """Run PageRank, components or label propagation and keep each node's value as a property."""
        from .adapters import analysis

        info = self._info(context)
        out = Ingest(self.store.load(info.id))
        self.commit(info.id, out, f"graph-analysis:{algorithm}", analysis.run(out.graph, algorithm))
        return out
