"""Graphs over the warehouse tables. Each is given as SQL that both Spark and the oracle run: a node query and an edge
query with contributions as columns (q, r), which ``graph`` folds into the model."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..operators.write import recompute_weights

COMMERCE_NODES = """
SELECT 'customer:' || c_custkey AS id, 'customer' AS node_type, 'structure' AS dimension, 'segment' AS pkey, c_mktsegment AS pval FROM customer
UNION ALL SELECT 'order:' || o_orderkey, 'order', 'temporal', 'status', o_orderstatus FROM orders
UNION ALL SELECT 'part:' || p_partkey, 'part', 'structure', 'brand', p_brand FROM part
UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', 'structure', 'label', s_name FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'nation', 'relational', 'label', n_name FROM nation
UNION ALL SELECT 'region:' || r_regionkey, 'region', 'relational', 'label', r_name FROM region"""
COMMERCE_EDGES = """
SELECT 'customer:' || o_custkey AS source, 'order:' || o_orderkey AS target, 'placed' AS relationship, 'structure' AS sd, 'temporal' AS td, CAST(NULL AS DOUBLE) AS q, CAST(NULL AS DOUBLE) AS r FROM orders
UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', 'temporal', 'structure', sum(l_quantity), sum(l_extendedprice * (1 - l_discount)) FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by', 'structure', 'structure', sum(l_quantity), NULL FROM lineitem GROUP BY l_partkey, l_suppkey
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 'structure', 'relational', NULL, NULL FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 'structure', 'relational', NULL, NULL FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'located_in', 'relational', 'relational', NULL, NULL FROM nation"""
TAG_NODES = """
SELECT 'fragment:' || o_orderkey AS id, 'fragment' AS node_type, 'structure' AS dimension, 'date' AS pkey, o_orderpriority AS pval FROM orders
UNION ALL SELECT DISTINCT 'concept:' || lower(p_brand || ':' || p_type), 'concept', 'semantic', 'label', lower(p_brand || ':' || p_type) FROM part"""
TAG_EDGES = """
SELECT DISTINCT 'fragment:' || l_orderkey AS source, 'concept:' || lower(p_brand || ':' || p_type) AS target, 'tagged_with' AS relationship, 'structure' AS sd, 'semantic' AS td, CAST(1 AS DOUBLE) AS q, CAST(NULL AS DOUBLE) AS r FROM lineitem JOIN part ON l_partkey = p_partkey"""
PROV_NODES = """
SELECT DISTINCT 'chain:' || conv_id AS id, 'chain' AS node_type, 'provenance' AS dimension, 'name' AS pkey, 'conversation ' || conv_id AS pval FROM conversations
UNION ALL SELECT 'mark:' || conv_id || ':' || turn, 'mark', 'provenance', 'chain_id', 'chain:' || conv_id FROM conversations
UNION ALL SELECT DISTINCT 'concept:' || role, 'concept', 'semantic', 'label', role FROM conversations"""
PROV_EDGES = """
SELECT 'chain:' || conv_id AS source, 'mark:' || conv_id || ':' || turn AS target, 'contains' AS relationship, 'provenance' AS sd, 'provenance' AS td, CAST(1 AS DOUBLE) AS q, CAST(NULL AS DOUBLE) AS r FROM conversations
UNION ALL SELECT 'mark:' || a.conv_id || ':' || a.turn, 'mark:' || b.conv_id || ':' || b.turn, 'links_to', 'provenance', 'provenance', 1, NULL FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
UNION ALL SELECT 'mark:' || conv_id || ':' || turn, 'concept:' || role, 'references', 'provenance', 'semantic', 1, NULL FROM conversations"""
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(spark: SparkSession, sf_dir: str, *sql: str) -> None:
    """Views of the tables that the statements name, of all without any."""
    for t in [t for t in TABLES if not sql or re.search(rf"\b{t}\b", " ".join(sql))]:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def edges_of(e: DataFrame, weigh: bool = True) -> DataFrame:
    """Columns of EDGE from (source, target, relationship, sd, td, q, r)."""
    c = F.map_filter(F.create_map(F.lit("quantity"), F.col("q"), F.lit("revenue"), F.col("r")), lambda _, v: v.isNotNull())
    out = e.select("source", "target", "relationship", F.col("sd").alias("source_dimension"), F.col("td").alias("target_dimension"), c.alias("contributions"), F.lit(1.0).alias("raw_weight"), F.create_map().cast("map<string,string>").alias("properties"), F.xxhash64("source", "target", "relationship").alias("seq"))
    return recompute_weights(out) if weigh else out


def graph(spark: SparkSession, sf_dir: str, nodes: str, edges: str, weigh: bool = True) -> Graph:
    views(spark, sf_dir, nodes, edges)
    n = spark.sql(nodes)
    kind = F.when(F.col("node_type") == "concept", "concept").when(F.col("dimension") == "provenance", "provenance").otherwise("document")
    n = n.select("id", "node_type", kind.alias("content_type"), "dimension", F.create_map("pkey", F.to_json(F.struct(F.col("pval").alias("v")))).alias("properties"))
    n = n.withColumn("properties", F.transform_values("properties", lambda _, v: F.regexp_extract(v, '^\\{"v":(.*)\\}$', 1)))
    return Graph(n, edges_of(spark.sql(edges), weigh))


def commerce(spark, sf_dir, weigh=True):
    return graph(spark, sf_dir, COMMERCE_NODES, COMMERCE_EDGES, weigh)


def tags(spark, sf_dir):
    return graph(spark, sf_dir, TAG_NODES, TAG_EDGES)


def provenance(spark, sf_dir):
    return graph(spark, sf_dir, PROV_NODES, PROV_EDGES)
