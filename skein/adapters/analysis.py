"""Results of graph analysis as property updates: of external algorithms (JSON), or of those that run here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import js
from ..model import Graph, bucketed, discard
from ..operators import enrich
from ..operators.write import Emission

RESULT = "struct<updates: array<struct<node_id: string, properties: map<string, variant>>>>"


def external(results: DataFrame) -> Emission:
    """Rows (agent, status, response) of an external analysis; only agents with status success count. Numbers become
    floating point, strings and booleans stay, arrays, objects and nulls are dropped."""
    v = F.try_parse_json("response")
    ups = F.try_variant_get(v, "$.updates", "array<variant>")
    u = results.where("status = 'success'").select(F.explode(ups).alias("u"))
    u = u.select(F.try_variant_get("u", "$.node_id", "string").alias("id"), F.explode(F.try_variant_get("u", "$.properties", "map<string,variant>")).alias("k", "x"))
    kind = F.schema_of_variant("x")
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    value = F.when(kind == "STRING", js(F.try_variant_get("x", "$", "string"))).when(kind == "BOOLEAN", F.to_json("x")).when(number, js(F.try_variant_get("x", "$", "double")))
    u = u.select("id", "k", value.alias("value")).where("id is not null and value is not null")
    one = u.groupBy("id", "k").agg(F.max("value").alias("value"))
    return Emission(updates=one.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("properties")))


def label_propagation(g: Graph, rounds: int = 5) -> DataFrame:
    """(id, community): in each round a node takes the label that most of its neighbours have, the least on a tie.

    Edges are held twice, by their greater and by their lesser end, so labels meet them where they are and only votes are
    shuffled. In the first round all labels differ, and the least neighbour wins."""
    size = int(g.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = bucketed(g.nodes.select(F.col("id").alias("v")).distinct(), "v")
    node = lambda c: ids.withColumnRenamed("v", c)
    s, t = F.col("source"), F.col("target")
    e = g.edges.where(s != t).select(F.greatest(s, t).alias("x"), F.least(s, t).alias("y")).repartition(size, "x").distinct()
    by_x = bucketed(e.join(node("x"), "x", "left_semi"), "x", True)
    by_y = bucketed(by_x.repartition(size, "y").join(node("y"), "y", "left_semi"), "y", True)
    if by_y.count() < by_x.count():  # a lesser end isn't a node
        by_x, old = bucketed(by_y, "x"), by_x
        discard(old)
    lab = ids.withColumn("l", F.col("v"))
    for k in range(rounds):
        if k:
            votes = by_x.join(lab.toDF("x", "l"), "x").select(F.col("y").alias("v"), "l").union(by_y.join(lab.toDF("y", "l"), "y").select(F.col("x").alias("v"), "l"))
            votes = votes.repartition(size, "v").groupBy("v", "l").agg(F.count("*").alias("n"))
            best = votes.groupBy("v").agg(F.min(F.struct((-F.col("n")).alias("o"), "l")).alias("b")).select("v", F.col("b.l").alias("new"))
        else:
            best = by_x.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("new"))
            other = by_y.groupBy(F.col("y").alias("v")).agg(F.min("x").alias("new2"))
            best = ids.join(best, "v", "left").join(other, "v", "left").select("v", F.least("new", "new2").alias("new"))
        old, lab = lab, bucketed(lab.join(best, "v", "left").select("v", F.coalesce("new", "l").alias("l")), "v", True)
        if k:
            discard(old)
    discard(by_x, by_y, *([ids] if rounds else []))
    return lab.toDF("id", "community")


ALGORITHMS: dict[str, Callable[[Graph], DataFrame]] = {"pagerank": enrich.pagerank, "components": enrich.components, "label_propagation": label_propagation}


def run(g: Graph, algorithm: str) -> Emission:
    """An algorithm's value of each node as a property named like its column; contributor ``graph-analysis:{algorithm}``."""
    r = ALGORITHMS[algorithm](g)
    (name,) = [c for c in r.columns if c != "id"]
    return Emission(updates=r.select("id", F.create_map(F.lit(name), js(F.col(name))).alias("properties")))
