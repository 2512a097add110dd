"""Streams as typed writes: every micro-batch is one upsert, so a batch that is repeated changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.database import Database


def upsert_stream(db: Database, table: str, stream: DataFrame, key: str, update: list[str], checkpoint: str, order: str | None = None, **trigger):
    """Starts a query that writes each micro-batch of stream into table by key.

    Of rows of one key within a batch the last by `order` counts (any, where none is given).
    """
    names = [c.name for c in db.schema(table)]

    def write(batch: DataFrame, number: int) -> None:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order or key).desc()))
        one = batch.withColumn("_rank", rank).filter(F.col(key).isNull() | (F.col("_rank") == 1)).select(*names)
        db.insert_rows(table, one, "do_update", key, update)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
