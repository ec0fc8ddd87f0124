"""The versioned store: snapshots of contexts, the event log and specs, all Parquet, under one folder.

A manifest (JSON, numbered) names the snapshot of every context, its metadata, the specs, the parts of the event log and
the last sequence number. A commit writes data first, then the next manifest under its number, which fails if another
writer was quicker; then the commit is merged with what that one wrote. Readers never see half a commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import EDGE, KEY, NODE, Graph
from .operators.write import EVENT, Result

SPEC = "adapter_id string, context_id string, spec_yaml string, loaded_at string"


def stamp() -> str:
    return datetime.now(UTC).isoformat()


@dataclass
class ContextInfo:
    """``sources``: of kind file (path), directory (path, recursive), url (url) or context (context_id)."""

    id: str
    name: str
    description: str = ""
    owner: str | None = None
    tags: list[str] = field(default_factory=list)
    sources: list[dict] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)
    created_at: str = ""
    updated_at: str = ""
    snapshot: str | None = None
    version: int = 0


@dataclass
class Manifest:
    version: int = 0
    contexts: dict[str, ContextInfo] = field(default_factory=dict)
    specs: list[dict] = field(default_factory=list)
    sequence: int = 0
    #: Parts of the event log by context.
    events: dict[str, list[str]] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer was quicker again and again."""


class GraphStore(Protocol):
    """What an engine needs of a store."""

    def manifest(self) -> Manifest: ...

    def change(self, edit: Callable[[Manifest], None]) -> Manifest: ...

    def load(self, context_id: str) -> Graph: ...

    def save(self, context_id: str, g: Graph, base: Graph | None = None) -> Graph: ...

    def append(self, context_id: str, adapter: str, result: Result) -> DataFrame | None: ...

    def events(self, context_id: str) -> DataFrame: ...


class ParquetStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.seen = -1

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # -- manifest --------------------------------------------------------------------------------------------------
    def latest(self) -> int:
        at = self._path("manifests")
        if not self.fs.exists(at):
            return 0
        return max((int(f.getPath().getName()) for f in self.fs.listStatus(at) if f.getPath().getName().isdigit()), default=0)

    def manifest(self) -> Manifest:
        self.seen = n = self.latest()
        if not n:
            return Manifest()
        s = self.fs.open(self._path(f"manifests/{n}"))
        try:
            d = json.loads(bytes(s.readAllBytes()))
        finally:
            s.close()
        return Manifest(d["version"], {k: ContextInfo(**v) for k, v in d["contexts"].items()}, d["specs"], d["sequence"], d["events"])

    def changed(self) -> bool:
        """Whether someone has committed since this store last read the manifest."""
        return self.latest() != self.seen

    def _put(self, m: Manifest) -> bool:
        from py4j.protocol import Py4JJavaError

        temp = self._path(f"manifests/_{uuid.uuid4().hex}")
        out = self.fs.create(temp, True)
        out.write(json.dumps(asdict(m)).encode())
        out.close()
        target = self._path(f"manifests/{m.version}")
        try:
            done = not self.fs.exists(target) and self.fs.rename(temp, target)
        except Py4JJavaError:
            done = False
        if not done:
            self.fs.delete(temp, False)
        return done

    def change(self, edit: Callable[[Manifest], None], tries: int = 10) -> Manifest:
        """Apply ``edit`` to the latest manifest and commit it; done again if another writer was quicker."""
        for _ in range(tries):
            m = self.manifest()
            edit(m)
            m.version += 1
            if self._put(m):
                self.seen = m.version
                return m
        raise Conflict(f"no commit in {tries} tries")

    # -- snapshots -------------------------------------------------------------------------------------------------
    def load(self, context_id: str) -> Graph:
        return self._graph(self.manifest().contexts[context_id].snapshot)

    def _graph(self, snapshot: str | None) -> Graph:
        if snapshot is None:
            return Graph(self.spark.createDataFrame([], NODE), self.spark.createDataFrame([], EDGE))
        return Graph(*(self.spark.read.schema(s).parquet(f"{self.root}/{snapshot}/{n}") for n, s in (("nodes", NODE), ("edges", EDGE))))

    def _write(self, context_id: str, g: Graph) -> str:
        name = f"data/{context_id}/{uuid.uuid4().hex}"
        columns = lambda s: [c.split()[0] for c in s.replace("map<string,", "map<string;").split(",")]
        g.nodes.select(columns(NODE)).write.parquet(f"{self.root}/{name}/nodes")
        g.edges.select(columns(EDGE)).write.parquet(f"{self.root}/{name}/edges")
        return name

    def save(self, context_id: str, g: Graph, base: Graph | None = None, base_snapshot: str | None = None) -> Graph:
        """Make ``g`` the snapshot of a context. If another writer has committed since ``base_snapshot``, whose graph is
        ``base``, rows that it added stay: those of its snapshot that aren't in ``base``."""
        name = self._write(context_id, g)

        def edit(m: Manifest) -> None:
            nonlocal name
            c = m.contexts[context_id]
            if base is not None and c.snapshot != base_snapshot and c.snapshot is not None:
                theirs, ours = self._graph(c.snapshot), self._graph(name)
                n = theirs.nodes.join(base.nodes.select("id"), "id", "left_anti").join(ours.nodes.select("id"), "id", "left_anti")
                e = theirs.edges.join(base.edges.select(KEY), KEY, "left_anti").join(ours.edges.select(KEY), KEY, "left_anti")
                name = self._write(context_id, Graph(ours.nodes.unionByName(n), ours.edges.unionByName(e)))
            c.snapshot, c.version, c.updated_at = name, c.version + 1, stamp()

        self.change(edit)
        return self._graph(name)

    # -- events ----------------------------------------------------------------------------------------------------
    def append(self, context_id: str, adapter: str, result: Result) -> DataFrame | None:
        """Log the result's changes; returns their rows. Sequence numbers are given by the commit, one for each event."""
        rows = result.events(adapter, context_id)
        if rows is None:
            return None
        name, count = f"events/{context_id}/{uuid.uuid4().hex}", sum(n > 0 for n in result.sizes.values())

        def edit(m: Manifest) -> None:
            part = f"{name}-{m.sequence}"
            rows.withColumn("sequence", F.col("sequence") + m.sequence).write.mode("overwrite").parquet(f"{self.root}/{part}")
            m.events.setdefault(context_id, []).append(part)
            m.sequence += count

        m = self.change(edit)
        return self.spark.read.schema(EVENT).parquet(f"{self.root}/{m.events[context_id][-1]}")

    def events(self, context_id: str) -> DataFrame: ...


class ParquetStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.seen = -1

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # -- manifest --------------------------------------------------------------------------------------------------
    def latest(self) -> int:
        at = self._path("manifests")
        if not self.fs.exists(at):
            return 0
        return max((int(f.getPath().getName()) for f in self.fs.listStatus(at) if f.getPath().getName().isdigit()), default=0)

    def manifest(self) -> Manifest:
        self.seen = n = self.latest()
        if not n:
            return Manifest()
        s = self.fs.open(self._path(f"manifests/{n}"))
        try:
            d = json.loads(bytes(s.readAllBytes()))
        finally:
            s.close()
        return Manifest(d["version"], {k: ContextInfo(**v) for k, v in d["contexts"].items()}, d["specs"], d["sequence"], d["events"])

    def changed(self) -> bool:
        """Whether someone has committed since this store last read the manifest."""
        return self.latest() != self.seen

    def _put(self, m: Manifest) -> bool:
        from py4j.protocol import Py4JJavaError

        temp = self._path(f"manifests/_{uuid.uuid4().hex}")
        out = self.fs.create(temp, True)
        out.write(json.dumps(asdict(m)).encode())
        out.close()
        target = self._path(f"manifests/{m.version}")
        try:
            done = not self.fs.exists(target) and self.fs.rename(temp, target)
        except Py4JJavaError:
            done = False
        if not done:
            self.fs.delete(temp, False)
        return done

    def change(self, edit: Callable[[Manifest], None], tries: int = 10) -> Manifest:
        """Apply ``edit`` to the latest manifest and commit it; done again if another writer was quicker."""
        for _ in range(tries):
            m = self.manifest()
            edit(m)
            m.version += 1
            if self._put(m):
                self.seen = m.version
                return m
        raise Conflict(f"no commit in {tries} tries")

    # -- snapshots -------------------------------------------------------------------------------------------------
    def load(self, context_id: str) -> Graph:
        return self._graph(self.manifest().contexts[context_id].snapshot)

    def _graph(self, snapshot: str | None) -> Graph:
        if snapshot is None:
            return Graph(self.spark.createDataFrame([], NODE), self.spark.createDataFrame([], EDGE))
        return Graph(*(self.spark.read.schema(s).parquet(f"{self.root}/{snapshot}/{n}") for n, s in (("nodes", NODE), ("edges", EDGE))))

    def _write(self, context_id: str, g: Graph) -> str:
        name = f"data/{context_id}/{uuid.uuid4().hex}"
        columns = lambda s: [c.split()[0] for c in s.replace("map<string,", "map<string;").split(",")]
        g.nodes.select(columns(NODE)).write.parquet(f"{self.root}/{name}/nodes")
        g.edges.select(columns(EDGE)).write.parquet(f"{self.root}/{name}/edges")
        return name

    def save(self, context_id: str, g: Graph, base: Graph | None = None, base_snapshot: str | None = None) -> Graph:
        """Make ``g`` the snapshot of a context. If another writer has committed since ``base_snapshot``, whose graph is
        ``base``, rows that it added stay: those of its snapshot that aren't in ``base``."""
        name = self._write(context_id, g)

        def edit(m: Manifest) -> None:
            nonlocal name
            c = m.contexts[context_id]
            if base is not None and c.snapshot != base_snapshot and c.snapshot is not None:
                theirs, ours = self._graph(c.snapshot), self._graph(name)
                n = theirs.nodes.join(base.nodes.select("id"), "id", "left_anti").join(ours.nodes.select("id"), "id", "left_anti")
                e = theirs.edges.join(base.edges.select(KEY), KEY, "left_anti").join(ours.edges.select(KEY), KEY, "left_anti")
                name = self._write(context_id, Graph(ours.nodes.unionByName(n), ours.edges.unionByName(e)))
            c.snapshot, c.version, c.updated_at = name, c.version + 1, stamp()

        self.change(edit)
        return self._graph(name)

    # -- events ----------------------------------------------------------------------------------------------------
    def append(self, context_id: str, adapter: str, result: Result) -> DataFrame | None:
        """Log the result's changes; returns their rows. Sequence numbers are given by the commit, one for each event."""
        draft = result.events(adapter, context_id)
        if draft is None:
            return None
        name = f"events/{context_id}/{uuid.uuid4().hex}"
        draft.write.parquet(f"{self.root}/{name}-draft")
        rows = self.spark.read.schema(EVENT).parquet(f"{self.root}/{name}-draft")
        count = rows.agg(F.max("sequence")).first()[0]

        def edit(m: Manifest) -> None:
            part = f"{name}-{m.sequence}"
            rows.withColumn("sequence", F.col("sequence") + m.sequence).write.mode("overwrite").parquet(f"{self.root}/{part}")
            m.events.setdefault(context_id, []).append(part)
            m.sequence += count

        m = self.change(edit)
        self.fs.delete(self._path(f"{name}-draft"), True)
        return self.spark.read.schema(EVENT).parquet(f"{self.root}/{m.events[context_id][-1]}")

    def events(self, context_id: str) -> DataFrame:
        parts = self.manifest().events.get(context_id, [])
        if not parts:
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).parquet(*[f"{self.root}/{p}" for p in parts])

    def compact_events(self, context_id: str) -> None:
        """Rewrite a context's log as one part, sorted by sequence."""
        whole = self.events(context_id)
        name = f"events/{context_id}/{uuid.uuid4().hex}"
        whole.repartitionByRange("sequence").sortWithinPartitions("sequence").write.parquet(f"{self.root}/{name}")
        before = self.manifest().events.get(context_id, [])

        def edit(m: Manifest) -> None:
            m.events[context_id] = [name, *[p for p in m.events.get(context_id, []) if p not in before]]

        self.change(edit)

    # -- upkeep ----------------------------------------------------------------------------------------------------
    def vacuum(self, context_id: str, keep: Sequence[str] = ()) -> int:
        """Delete snapshots of a context that no manifest version in use names; returns how many."""
        at = self._path(f"data/{context_id}")
        if not self.fs.exists(at):
            return 0
        c = self.manifest().contexts.get(context_id)
        used = {*keep, *([c.snapshot] if c and c.snapshot else [])}
        old = [f.getPath() for f in self.fs.listStatus(at) if f"data/{context_id}/{f.getPath().getName()}" not in used]
        for p in old:
            self.fs.delete(p, True)
        return len(old)
