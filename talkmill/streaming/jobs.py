"""Runs streams to completion over what is there, into a table that batch code reads."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from talkmill.session import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """transformWithState needs RocksDB; a session that already names a store keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, "") or ""):
        spark.conf.set(name, ROCKSDB)


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over all available input and return what it wrote.

    Output and progress live in the shared folder, so a restarted run goes on from its
    checkpoint and the file sink keeps results exactly once.
    """
    spark = stream.sparkSession
    use_state_store(spark)
    root = folder or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    query = (stream.writeStream.outputMode(mode).format("parquet")
             .option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def append_log(stream: DataFrame, folder: str, progress: str,
               crash: Callable[[int], None] | None = None) -> None:
    """Append all available rows of a stream to a log, exactly once.

    Every micro-batch owns the folder ``batch=<id>`` and overwrites it.  A run that dies
    between writing a batch and committing it finds the same batch again, by its id and with
    the same input, and writes it once more in the same place.  ``crash`` is called after
    each write; tests raise from it.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if crash is not None:
            crash(number)

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", progress)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def read_log(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All rows of such a log; ``batch`` tells by which micro-batch each came."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(
        "batch", T.LongType())])).parquet(folder)
