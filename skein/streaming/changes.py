"""A context's event log as a stream, and ingest of a stream of inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import every
from ..operators.write import EVENT


def changes(spark: SparkSession, root: str, context_id: str, cursor: int = 0, adapter_id: str | None = None, event_types: Sequence[str] = ()) -> DataFrame:
    """Events of a context after ``cursor`` as they are logged; the stream's checkpoint is the cursor from then on.
    Delivery is at least once: a part that lost a race for its sequence numbers is seen, too, and compaction of the log
    gives events again. Keep (sequence, part) of the highest ones to tell."""
    parts = spark.readStream.schema(EVENT).option("pathGlobFilter", "*.parquet").parquet(f"{root}/events/{context_id}/*-[0-9]*")
    c = every([F.col("sequence") > cursor, None if adapter_id is None else F.col("adapter_id") == adapter_id, F.col("event_type").isin(*event_types) if event_types else None])
    return parts.where(c)


def ingest(inputs: DataFrame, engine, context: str, kind: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Ingest a stream of rows (value: JSON): a micro-batch is an ingest, followed by the enrichments. Ids and merges are
    deterministic, so a batch that is run again after a failure changes nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            engine.ingest(context, rows.select("value").withColumn("ord", F.monotonically_increasing_id()), kind)

    w = inputs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
