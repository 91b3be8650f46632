"""Exact dense retrieval by squared Euclidean distance, and its stored index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paperloom.operators import cells

DIGITS = 9
#: Distances that a task holds at a time, 32 MB.
CELLS = 4_000_000
#: What a top_k of 0 or None means.
TOP_K = 10
#: Query vectors that may be sent to all tasks; 64 values make it about 5 MB.
BLOCK = 4096


def top_k(queries: DataFrame, corpus: DataFrame, k: int | None = TOP_K) -> DataFrame:
    """qid, rank, doc_id, distance of the k nearest of corpus(doc_id, embedding) for each of queries(qid, embedding).

    A stated query set meets all rows. Up to BLOCK queries are sent to all tasks, where an Arrow batch of vectors meets them
    in one matrix product; what that leaves within its error of the k best is measured exactly, and a
    task sends k rows a query. Beyond that slices of queries and parts of vectors are shuffled to each other (``cells.scan``). Vectors that are null
    or of another length than the queries' are left out. A k of 0 or None is the default.
    """
    k = k or TOP_K
    spark = corpus.sparkSession
    known = queries.filter("qid is not null and embedding is not null").select("qid", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = known.limit(BLOCK + 1).collect()
    if len(asked) > BLOCK or len({len(r["embedding"]) for r in asked}) > 1:
        return cells.scan(queries, corpus, k)
    kinds = queries.select("qid").schema[0].dataType, corpus.select("doc_id").schema[0].dataType
    schema = T.StructType([T.StructField("qid", kinds[0]), T.StructField("doc_id", kinds[1]), T.StructField("distance", T.DoubleType())])
    if not asked:
        near = spark.createDataFrame([], schema)
    else:
        rows = corpus.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"))
        shared = spark.sparkContext.broadcast(([r["qid"] for r in asked], np.array([r["embedding"] for r in asked], float)))
        near = rows.mapInArrow(nearest(shared, k, to_arrow_schema(schema)), schema)
    order = Window.partitionBy("qid").orderBy("distance", "doc_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", "distance")


def nearest(shared, k: int, kinds: pa.Schema):
    """A function from Arrow batches (doc_id, embedding) to each query's k nearest among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        own = (asked * asked).sum(1)
        best: list[list[tuple[float, object]]] = [[] for _ in ids]
        step = max(1, CELLS // max(1, len(ids)))
        for batch in (whole.slice(a, step) for whole in batches for a in range(0, whole.num_rows, step)):
            length = pc.equal(pc.list_value_length(batch.column(1)), asked.shape[1])
            batch = batch.filter(pc.fill_null(length, False))
            if not batch.num_rows:
                continue
            docs, values = batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            size = (values * values).sum(1)
            rough = own[:, None] + size[None, :] - 2 * asked @ values.T
            # what rounding and the product's error may hide
            slack = 1e-12 * (own[:, None] + size[None, :]) * asked.shape[1] + 10.0**-DIGITS
            for q, held in enumerate(best):
                upper = np.partition((rough[q] + slack[q]), k - 1)[k - 1] if len(docs) > k else np.inf
                if len(held) == k:
                    upper = min(upper, held[-1][0] + 10.0**-DIGITS)
                some = np.flatnonzero(rough[q] - slack[q] <= upper)
                if len(some):
                    exact = np.round(((values[some] - asked[q]) ** 2).sum(1), DIGITS).tolist()
                    held += zip(exact, (docs[i] for i in some.tolist()), strict=True)
                    held.sort(key=lambda x: (x[0], x[1] is not None, x[1]) if x[1] is not None else (x[0], False, 0))
                    del held[k:]
        for a in range(0, len(ids), 1000):
            rows = [(ids[q], doc, d) for q in range(a, min(a + 1000, len(ids))) for d, doc in best[q]]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], names=kinds.names)

    return run


def stored_index(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The index at path if it can be read, else (or with rebuild) build() written there: (doc_id, embedding)."""
    if not rebuild:
        try:
            return spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001  any unreadable index is built anew
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
