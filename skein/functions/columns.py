"""Columns of nodes and edges: property values are JSON, so a string and a number of the same text differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_PROPERTIES = "map<string,string>"


def js(c: Column) -> Column:
    """The JSON text of a value; null stays null."""
    j = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), j.substr(F.lit(6), F.length(j) - 6))


def props(**values: Column | None) -> Column:
    """A property map of JSON values without those that are null."""
    kv = [x for k, v in values.items() if v is not None for x in (F.lit(k), js(v))]
    return F.map_filter(F.create_map(*kv).cast("map<string,string>"), lambda _, v: v.isNotNull()) if kv else F.create_map().cast(NO_PROPERTIES)


def text_of(key: str, properties: str = "properties") -> Column:
    """A property as text: strings without their quotes, other values as JSON."""
    return F.get_json_object(F.concat(F.lit('{"v":'), F.col(properties)[key], F.lit("}")), "$.v")


def string_of(key: str, properties: str = "properties") -> Column:
    """A property only if it is a string."""
    return F.when(F.col(properties)[key].startswith('"'), text_of(key, properties))


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def node(id: Column, node_type: str | Column, content_type: str | Column, dimension: str | Column, properties: Column) -> list[Column]:
    """Columns of NODE."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [id.alias("id"), c(node_type).alias("node_type"), c(content_type).alias("content_type"), c(dimension).alias("dimension"), properties.alias("properties")]


def edge(source: Column, target: Column, relationship: str | Column, source_dimension: str | Column, target_dimension: str | Column, seq: Column, weight: Column | None = None, contributions: Column | None = None, properties: Column | None = None) -> list[Column]:
    """Columns of EDGE; weight 1 and no contributions unless given."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.create_map().cast("map<string,double>")
    return [
        source.alias("source"),
        target.alias("target"),
        c(relationship).alias("relationship"),
        c(source_dimension).alias("source_dimension"),
        c(target_dimension).alias("target_dimension"),
        (none if contributions is None else contributions).alias("contributions"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("raw_weight"),
        (F.create_map().cast(NO_PROPERTIES) if properties is None else properties).alias("properties"),
        seq.cast("bigint").alias("seq"),
    ]


def concept(label: Column, **more: Column | None) -> list[Column]:
    """Columns of a concept node: its id and label are the label in lower case."""
    low = F.lower(label)
    return node(F.concat(F.lit("concept:"), low), "concept", "concept", "semantic", props(label=low, **more))
