"""Change-driven execution: a stream of change events updates a stored result batch by batch.

An event has ``_id``, ``seq``, ``before`` and ``after`` (rows as structs; null for no row).  Each micro-batch is
reduced to its net change, evaluated as signed rows, and merged into the sink.  Folder sinks take the batch's number in the same rename as its
result, wide columns tag its cells with it, so a restart from the checkpoint applies every event once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomql.lang.parser import parse
from loomql.operators.incremental import net_changes
from loomql.plans.run import apply_changes
from loomql.sources import paths
from loomql.sources.registry import create


def _engines(spark: SparkSession, text: str):
    (transformation,) = parse(text)
    plain = {k: v for k, v in transformation.source.parameters.items() if k != "triggerbased"}
    return transformation, create(spark, transformation.source.name, plain), create(spark, transformation.sink.name, transformation.sink.parameters)


def apply_batch(spark: SparkSession, text: str, events: DataFrame) -> bool:
    """Apply a table of change events to the sink of a one-transformation script."""
    transformation, source, sink = _engines(spark, text)
    return apply_changes(transformation, net_changes(events), source, sink)


def start(spark: SparkSession, text: str, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Run a script for every micro-batch of a streaming table of change events.

    The sink itself carries the number of the last batch, written with the batch's result, so a batch
    that was applied before a crash isn't applied again.
    """
    _engines(spark, text)  # fail before anything runs
    stream = f"stream {checkpoint}"

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        sink = _engines(session, text)[2]
        if number <= sink.marks().get(stream, -1):
            return
        batch.persist()
        try:
            with paths.marked(stream, number):
                apply_batch(session, text, batch)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", f"{checkpoint}/stream").trigger(**(trigger or {"availableNow": True})).start()


def read_log(spark: SparkSession, path: str, since: int) -> DataFrame:
    """Events of an append-only change log (Parquet) with ``seq`` greater than ``since``."""
    return spark.read.parquet(path).where(F.col("seq") > since)
