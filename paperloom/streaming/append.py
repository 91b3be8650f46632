"""Streams of new corpus documents, appended without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.corpus import first_wins

#: Keys of a batch that may be sent to the stored table's tasks, about 60 MB; beyond that stored keys are shuffled.
BROADCAST_KEYS = 1_000_000


def append_stream(new: DataFrame, path: str, checkpoint: str, key: str = "doc_id", order: str = "pos") -> StreamingQuery:
    """Add each batch's unseen keys to the Parquet table at path; a repeated batch adds nothing, so writes are effectively once.

    A batch's keys go to the stored ones, of which only their column is read and only those that match are shuffled.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = first_wins(batch, [key], [order])
        try:
            old = spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            fresh.write.mode("append").parquet(path)
            return
        keys = fresh.select(key)
        if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
            keys = F.broadcast(keys)
        known = old.select(key).join(keys, key, "left_semi")
        fresh.select(*old.columns).join(known, key, "left_anti").write.mode("append").parquet(path)

    return new.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
