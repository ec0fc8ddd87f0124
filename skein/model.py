"""The graph model: nodes, directed typed multi-edges with a contribution per producer, and deterministic ids."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id string, node_type string, content_type string, dimension string, properties map<string,string>"
EDGE = "source string, target string, relationship string, source_dimension string, target_dimension string, contributions map<string,double>, raw_weight double, properties map<string,string>, seq bigint"
KEY = ["source", "target", "relationship", "source_dimension", "target_dimension"]
CONTENT_TYPES = ("code", "movement", "narrative", "concept", "document", "agent", "provenance")
DNS, SPEC = "6ba7b8109dad11d180b400c04fd430c8", "7cb8c920aebe11ef90b400c04fd430c9"


@dataclass(frozen=True)
class Graph:
    """A snapshot of one context. ``nodes`` has the columns of NODE, ``edges`` those of EDGE; property values are JSON."""

    nodes: DataFrame
    edges: DataFrame

    def where_edges(self, cond: Column | None) -> Graph:
        return self if cond is None else replace(self, edges=self.edges.where(cond))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session that has none is given a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skein-graph-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: cuts the lineage of loops and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, there: bool = False) -> DataFrame:
    """``df`` written like ``saved``, hashed by a column: joins and groups by that column read it without a shuffle.
    ``there``: it is made of other such tables by that column, and needs no shuffle to be written."""
    spark = df.sparkSession
    name = f"graph_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df if there else df.repartition(n, column)).write.format("parquet").bucketBy(n, column).option("path", path).saveAsTable(name)
    return spark.table(name)


def discard(*tables: DataFrame) -> None:
    """Delete what ``saved`` or ``bucketed`` wrote, once nothing reads it any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            name = folder.rpartition("/")[2]
            if name.startswith("graph_"):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5, as a string."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def concept_id(label: Column) -> Column:
    return F.concat(F.lit("concept:"), F.lower(label))


def fragment_id(adapter: Column, text: Column, tags: Column) -> Column:
    low = F.array_sort(F.transform(tags, F.lower))
    return F.concat(F.lit("fragment:"), uuid5(DNS, F.concat_ws(":", adapter, text, F.array_join(low, ","))))


def chain_id(adapter: Column, source: Column) -> Column:
    return F.concat_ws(":", F.lit("chain"), adapter, F.coalesce(source, F.lit("default")))


def named_chain_id(name: Column) -> Column:
    return F.concat(F.lit("chain:provenance:"), F.regexp_replace(F.lower(name), "[ \\t\\n\\r:/]", "-"))


def mark_id(adapter: Column, fragment: Column) -> Column:
    return F.concat_ws(":", F.lit("mark"), adapter, fragment)


def edge_id(context: Column | str = "") -> Column:
    """Deterministic: the same logical key in the same context has the same id."""
    return F.sha2(F.concat_ws("\x1f", F.lit(context) if isinstance(context, str) else context, *KEY), 256)


def empty(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE))
