"""Vectors of nodes: a store by model, nearest neighbours, and the enrichment that embeds new nodes only."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import string_of
from ..model import Graph, saved, shared_folder
from . import enrich
from .blocks import between

VECTOR = "node_id string, model string, embedding array<float>"
#: Neighbours that a search returns for each vector.
NEAREST = 100


class VectorStore:
    """Vectors of one context in Parquet; each ``store`` adds a part. Without a path, below the checkpoint folder."""

    def __init__(self, path: str | None = None):
        self.path, self.parts = path, 0

    def folder(self, spark) -> str:
        self.path = self.path or f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
        return self.path

    def all(self, spark, model: str) -> DataFrame:
        """(id, embedding); the last vector stored of a node counts."""
        try:
            t = spark.read.schema(VECTOR + ", part int").parquet(self.folder(spark))
        except AnalysisException:
            return spark.createDataFrame([], "id string, embedding array<float>")
        t = t.where(F.col("model") == model)
        return t.groupBy(F.col("node_id").alias("id")).agg(F.max_by("embedding", "part").alias("embedding"))

    def has(self, spark, model: str, ids: DataFrame) -> DataFrame:
        return ids.join(self.all(spark, model).select("id"), "id", "left_semi")

    def store(self, vectors: DataFrame, model: str) -> None:
        """Add vectors (id, embedding), scaled to length 1."""
        v = F.col("embedding").cast("array<double>")
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        unit = F.transform(v, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x / norm))
        spark, self.parts = vectors.sparkSession, self.parts + 1
        vectors.select(F.col("id").alias("node_id"), F.lit(model).alias("model"), unit.cast("array<float>").alias("embedding"), F.lit(self.parts).alias("part")).write.mode("append").parquet(self.folder(spark))

    def find_similar(self, queries: DataFrame, model: str, threshold: float, k: int | None = NEAREST) -> DataFrame:
        """(id, other, similarity) of the ``k`` nearest other vectors (None: all) of at least the threshold."""
        found = between(queries, self.all(queries.sparkSession, model), threshold, k)
        if k is None:
            return found
        best = W.partitionBy("id").orderBy(F.desc("similarity"), "other")
        return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def embedder(model: Callable[[list[str]], list[list[float]]]) -> Callable[[DataFrame], DataFrame]:
    """An embedder from a function of a batch of labels, run in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model(b.column(1).to_pylist()), pa.list_(pa.float32()))], ["id", "embedding"])

    return lambda labels: labels.select("id", "label").mapInArrow(run, "id string, embedding array<float>")


def similarity(model: str, embed: Callable[[DataFrame], DataFrame], store: VectorStore, threshold: float = 0.7, out: str = "similar_to", dimension: str | None = "semantic") -> enrich.Enrichment:
    """Embeds nodes of the dimension with a string label that have no vector yet, and links each to all vectors that are
    similar enough, those of the same batch included. If embedding fails, nothing is added."""

    def run(g: Graph) -> DataFrame | None:
        spark = g.nodes.sparkSession
        n = g.nodes if dimension is None else g.nodes.where(F.col("dimension") == dimension)
        n = n.select("id", string_of("label").alias("label")).where("label is not null")
        fresh = saved(n.join(store.all(spark, model).select("id"), "id", "left_anti"))
        if fresh.isEmpty():
            return None
        try:
            new = saved(embed(fresh))
        except PythonException:  # what a model raises
            return None
        store.store(new, model)
        pairs = between(new, store.all(spark, model), threshold).select(F.least("id", "other").alias("source"), F.greatest("id", "other").alias("target"), F.col("similarity").alias("w"))
        pairs = pairs.groupBy("source", "target").agg(F.max("w").alias("w"))
        return enrich._edges(enrich._new(enrich._both(pairs), g, out), out, f"embedding:{model}")

    return enrich.Enrichment(f"embedding:{model}", run, ("NodesAdded",))
