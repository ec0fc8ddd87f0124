"""Chains, marks and links: each mutation is a small emission. Reads of the present state are single look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import edge, js, node, props
from ..model import Graph
from ..operators.write import Emission, last_wins

KIND = ADAPTER = "provenance"


def _value(x):
    return None if x is None else F.array(*map(F.lit, x)).cast("array<string>") if isinstance(x, (list, tuple)) else F.lit(x)


def create_chain(spark: SparkSession, chain_id: str, name: str, description: str | None = None) -> Emission:
    if not name.strip():
        raise ValueError("chain name must not be empty")
    p = props(name=_value(name), description=_value(description), status=F.lit("active"))
    return Emission(nodes=spark.range(1).select(*node(F.lit(chain_id), "chain", "provenance", "provenance", p)))


def add_mark(spark: SparkSession, mark_id: str, chain_id: str, file: str, line: int, annotation: str, column: int | None = None, mark_type: str | None = None, tags: Sequence[str] | None = None) -> Emission:
    p = props(chain_id=_value(chain_id), file=_value(file), line=_value(line), annotation=_value(annotation), column=_value(column), type=_value(mark_type), tags=_value(None if tags is None else list(tags)))
    one = spark.range(1)
    return Emission(nodes=one.select(*node(F.lit(mark_id), "mark", "provenance", "provenance", p)), edges=one.select(*edge(F.lit(chain_id), F.lit(mark_id), "contains", "provenance", "provenance", F.lit(0))))


def add_marks(marks: DataFrame) -> Emission:
    """Many marks at once: mark_id, chain_id, file, line, annotation, and column, type, tags where present."""
    have = {c: F.col(c) for c in ("column", "type", "tags") if c in marks.columns}
    p = props(chain_id=F.col("chain_id"), file=F.col("file"), line=F.col("line"), annotation=F.col("annotation"), **have)
    return Emission(nodes=marks.select(*node(F.col("mark_id"), "mark", "provenance", "provenance", p)), edges=marks.select(*edge(F.col("chain_id"), F.col("mark_id"), "contains", "provenance", "provenance", F.xxhash64("mark_id"))))


def link_marks(g: Graph, source: str, target: str) -> Emission:
    missing = {source, target} - {r.id for r in g.nodes.where(F.col("id").isin(source, target)).select("id").collect()}
    if missing:
        raise KeyError(f"mark not found: {min(missing)}")
    return Emission(edges=g.nodes.sparkSession.range(1).select(*edge(F.lit(source), F.lit(target), "links_to", "provenance", "provenance", F.lit(0))))


def unlink_marks(spark: SparkSession, source: str, target: str) -> Emission:
    return Emission(edge_removals=spark.range(1).select(F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit("links_to").alias("relationship")))


def delete_mark(spark: SparkSession, mark: str) -> Emission:
    return Emission(removals=spark.range(1).select(F.lit(mark).alias("id")))


def delete_chain(g: Graph, chain: str) -> Emission:
    """The chain and the marks that it contains; their edges go with them."""
    own = g.nodes.where(F.col("id") == chain).select("id")
    if own.isEmpty():
        raise KeyError(f"chain not found: {chain}")
    marks = g.edges.where((F.col("source") == chain) & (F.col("relationship") == "contains")).select(F.col("target").alias("id"))
    return Emission(removals=marks.union(own).distinct())


def _rewritten(g: Graph, id: str, what: str, **values) -> Emission:
    n = g.nodes.where(F.col("id") == id)
    if n.isEmpty():
        raise KeyError(f"{what} not found: {id}")
    changed = {k: js(_value(v)) for k, v in values.items() if v is not None}
    new = F.create_map(*[x for k, v in changed.items() for x in (F.lit(k), v)]) if changed else F.create_map().cast("map<string,string>")
    return Emission(nodes=n.withColumn("properties", last_wins(F.coalesce("properties", F.create_map().cast("map<string,string>")), new)))


def update_mark(g: Graph, mark: str, annotation: str | None = None, line: int | None = None, column: int | None = None, mark_type: str | None = None, tags: Sequence[str] | None = None) -> Emission:
    return _rewritten(g, mark, "mark", annotation=annotation, line=line, column=column, type=mark_type, tags=None if tags is None else list(tags))


def archive_chain(g: Graph, chain: str) -> Emission:
    return _rewritten(g, chain, "chain", status="archived")


OUTBOUND = {"NodesAdded": "provenance_updated", "EdgesAdded": "edges_added", "NodesRemoved": "provenance_removed", "EdgesRemoved": "edges_removed"}


def outbound(events: DataFrame) -> DataFrame:
    """(kind, detail) for events of this adapter: ids of a row, joined."""
    kinds = F.create_map(*[F.lit(x) for kv in OUTBOUND.items() for x in kv])
    e = events.where(F.col("adapter_id") == ADAPTER).withColumn("kind", F.element_at(kinds, F.col("event_type")))
    ids = F.when(F.col("event_type").startswith("Nodes"), F.col("node_ids")).otherwise(F.col("edge_ids"))
    return e.where("kind is not null").select("kind", F.array_join(ids, ", ").alias("detail")).where("detail <> ''")
