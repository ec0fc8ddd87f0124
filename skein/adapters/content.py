"""Content ingest: fragments of text with tags become fragment, concept, chain and mark nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import concept, edge, node, now, props
from ..model import chain_id, fragment_id, mark_id, named_chain_id
from ..operators.write import Emission

KIND = "content"
FIELDS = {"text": "string", "tags": "array<string>", "source": "string", "date": "string", "chain_name": "string", "file": "string", "line": "bigint", "column": "bigint"}


def parse(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inputs, rejected) from a column ``value`` of JSON objects and an optional ``ord``.

    Text is required and must be a string. Tags that aren't strings are dropped, other fields of a wrong type ignored;
    lines and columns are integers from 0 to 2^32 - 1.
    """
    v = F.try_parse_json("value")

    def field(name: str) -> Column:
        x = F.try_variant_get(v, f"$.{name}", "variant")
        kind = F.schema_of_variant(x)
        if FIELDS[name] == "string":
            return F.when(kind == "STRING", F.try_variant_get(x, "$", "string"))
        if FIELDS[name] == "bigint":
            n = F.try_variant_get(x, "$", "bigint")
            return F.when((kind == "BIGINT") & n.between(0, 2**32 - 1), n)
        items = F.filter(F.try_variant_get(x, "$", "array<variant>"), lambda i: F.schema_of_variant(i) == "STRING")
        return F.coalesce(F.transform(items, lambda i: F.try_variant_get(i, "$", "string")), F.array().cast("array<string>"))

    order = F.col("ord") if "ord" in raw.columns else F.monotonically_increasing_id()
    d = raw.select("value", order.alias("ord"), *[field(f).alias(f) for f in FIELDS])
    return d.where("text is not null").drop("value"), d.where("text is null").select("ord", "value", F.lit("text is required").alias("reason"))


def full(inputs: DataFrame) -> DataFrame:
    """All columns of FIELDS and ``ord``; those not given are null. Rows without text are left out."""
    have = set(inputs.columns)
    cols = [F.col(f).cast(t).alias(f) if f in have else F.lit(None).cast(t).alias(f) for f, t in FIELDS.items()]
    order = F.col("ord") if "ord" in have else F.monotonically_increasing_id()
    return inputs.select(order.alias("ord"), *cols).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).where("text is not null")


def emission(inputs: DataFrame, adapter: str = "content", stamp: Column | None = None) -> Emission:
    """A fragment with its concepts (``tagged_with``, weight 1), and a mark in the chain of its source or of the named
    one. Equal ids in a batch: the row with the greatest ``ord`` wins."""
    a, stamp = F.lit(adapter), now() if stamp is None else stamp
    d = full(inputs).withColumn("frag", fragment_id(a, F.col("text"), F.col("tags")))
    source = F.coalesce("source", F.lit("default"))
    named = F.col("chain_name").isNotNull()
    d = d.withColumn("chain", F.when(named, named_chain_id(F.col("chain_name"))).otherwise(chain_id(a, F.col("source"))))
    chain_name = F.when(named, F.col("chain_name")).otherwise(F.concat(a, F.lit(" — "), source))
    tagged = d.select("frag", "ord", F.posexplode("tags").alias("i", "tag"))
    low = F.when(F.size("tags") > 0, F.transform("tags", F.lower))
    mark = props(chain_id=F.col("chain"), annotation=F.col("text"), file=F.coalesce("file", source), line=F.coalesce("line", F.lit(1).cast("bigint")), column=F.col("column"), tags=low)
    at = F.col("ord").alias("ord")
    nodes = d.select(*node(F.col("frag"), "fragment", "document", "structure", props(text=F.col("text"), created_at=stamp, source=F.col("source"), date=F.col("date"))), at)
    nodes = nodes.unionByName(tagged.select(*concept(F.col("tag"), created_at=stamp), at))
    nodes = nodes.unionByName(d.select(*node(F.col("chain"), "chain", "provenance", "provenance", props(name=chain_name, status=F.lit("active"))), at))
    nodes = nodes.unionByName(d.select(*node(mark_id(a, F.col("frag")), "mark", "provenance", "provenance", mark), at))
    edges = tagged.select(*edge(F.col("frag"), F.concat(F.lit("concept:"), F.lower("tag")), "tagged_with", "structure", "semantic", F.col("ord")))
    edges = edges.unionByName(d.select(*edge(F.col("chain"), mark_id(a, F.col("frag")), "contains", "provenance", "provenance", F.col("ord"))))
    return Emission(nodes=nodes, edges=edges)


def outbound(added: DataFrame) -> DataFrame:
    """(kind, detail) of what was added (ids): ``fragment_indexed`` for each fragment, and ``concepts_detected`` for each
    part of the concepts. The list is cut into parts of some 10,000, so that no row grows with the batch."""
    f = added.where(F.col("id").startswith("fragment:")).select(F.lit("fragment_indexed").alias("kind"), F.col("id").alias("detail"))
    c = added.where(F.col("id").startswith("concept:")).select(F.substring("id", 9, 1 << 30).alias("label")).distinct()
    parts = max(1, -(-c.count() // 10_000))
    c = c.groupBy(F.pmod(F.xxhash64("label"), F.lit(parts)).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("detail"))
    return f.unionByName(c.select(F.lit("concepts_detected").alias("kind"), "detail"))
