"""Upserts from a stream: each micro-batch is a folder of its own, the newest row of a key counts.

A batch that runs again after a failure overwrites its own folder, so no row
counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_upserts(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], **trigger) -> StreamingQuery:
    """Append the newest row of each key of each batch below ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        _newest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The table as of now; later batches win over earlier ones."""
    return _newest(spark.read.parquet(path), keys, ["batch", *order]).drop("batch")


def _newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_n", best).where("_n = 1").drop("_n")
