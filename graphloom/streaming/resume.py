"""Incremental runs over a folder of JSON lines: each file is taken once, and a stopped run goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.graph_store import GraphStore


def run_available(spark: SparkSession, folder: str, schema: StructType | str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Takes what is new in folder through step and appends it to out (Parquet); returns when that is done."""
    rows = step(spark.readStream.schema(schema).json(folder))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_available(spark: SparkSession, folder: str, schema: StructType | str, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]], store: GraphStore, checkpoint: str, name: str = "edges") -> None:
    """Takes what is new in folder through step (to nodes and edges) and upserts it into the graph; returns when that is done.

    Each batch is one commit that notes its number. A batch that was committed but not noted as done by the stream, because the run was
    stopped in between, comes again with its number and is left out.
    """

    def upsert(rows: DataFrame, number: int) -> None:
        if number > store.done(name):
            rows = rows.persist()
            try:
                nodes, edges = step(rows)
                store.upsert(nodes, edges, batch=(name, number))
            finally:
                rows.unpersist()

    spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
