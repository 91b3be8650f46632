"""A stored vector index in cells, searched exactly.

Centres come from a few rounds of k-means over a bounded sample; every vector lies in the cell of its nearest centre. A cell's radius is
the greatest distance of its vectors from the centre, so by the triangle inequality none of them is nearer to a query than the query's distance from
the centre less the radius. Each query first reads the FIRST cells with the lowest such bounds; what is k-th best there is its limit, and then only cells whose
bound doesn't pass the limit are read. Queries are shuffled to cells, never collected; a cell with many vectors is dealt in parts of PART_ROWS, and its
queries in slices, so no task holds more than a part and a slice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.sources.store import Versions
from paperloom.workspace import stored, work_dir

DIGITS = 9
TOP_K = 10
#: Vectors that the centres are fitted on, at most; centres, at most; and rounds. All are a few MB on the driver.
SAMPLE, CENTRES, ROUNDS = 20_000, 1024, 8
#: Vectors in a part of a cell and queries in a slice, on average, and cells that a query reads first.
PART_ROWS, SLICE, FIRST = 16_384, 4096, 2
#: What rounding may hide, as a share of the lengths compared.
SLACK = 1e-9
FORM = "cells-1"


@dataclass(frozen=True)
class Cells:
    """centres: cell, centre, radius, n, parts (a row for each cell, CENTRES at most); vectors: cell, part, doc_id, embedding."""

    spark: SparkSession
    path: str
    folder: str

    @property
    def centres(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.folder}/centres")

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.folder}/vectors")


@dataclass(frozen=True)
class Found:
    """hits: qid, rank, doc_id, distance. read: qid and n, the vectors that were compared with it."""

    hits: DataFrame
    read: DataFrame


def matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def usual(rows: DataFrame, id_: str) -> DataFrame:
    """The rows' vectors as doubles, without those that are null, empty, or hold a null or no number."""
    known = rows.select(id_, F.col("embedding").cast("array<double>").alias("embedding")).filter("size(embedding) > 0")
    known = known.filter("qid is not null") if id_ == "qid" else known
    return known.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))


def fitted(sample: np.ndarray, centres: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Centres by k-means; a centre that loses all its vectors stays where it was."""
    rng = np.random.default_rng(seed)
    now = sample[rng.choice(len(sample), min(centres, len(sample)), replace=False)]
    for _ in range(rounds):
        cell = nearest_centre(sample, now)
        sums, n = np.zeros_like(now), np.bincount(cell, minlength=len(now))
        np.add.at(sums, cell, sample)
        now = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], now)
    return now


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1)[None, :] - 2 * x @ centres.T, axis=1)


def build(vectors: DataFrame, path: str, centres: int | None = None) -> Cells:
    """Store the index of vectors(doc_id, embedding) as a new version of what is at path. Vectors of another length than most are left out.

    centres: how many; the square root of the vectors' number unless given.
    """
    spark = vectors.sparkSession
    versions = Versions(spark, path)
    base, folder = versions.latest()[0], versions.folder("cells")
    full = versions.full(folder)
    known = usual(vectors, "doc_id")
    sizes = known.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    size, total = (sizes["size"], sizes["n"]) if sizes else (0, 0)
    known = known.filter(F.size("embedding") == size)
    wanted = min(CENTRES, max(1, centres or round(total**0.5)))
    # by hash of the id, so that the same vectors give the same centres
    sample = [r[0] for r in known.orderBy(F.xxhash64("doc_id")).limit(SAMPLE).select("embedding").collect()]
    shared = spark.sparkContext.broadcast(fitted(np.array(sample, float), wanted) if sample else np.zeros((1, max(1, size))))

    def place(batches):
        for batch in batches:
            x = matrix(batch.column(1), batch.num_rows)
            cell = nearest_centre(x, shared.value) if len(x) else np.empty(0, np.int64)
            far = np.sqrt(((x - shared.value[cell]) ** 2).sum(1)) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(far, pa.float64())], names=["doc_id", "embedding", "cell", "far"])

    kind = vectors.schema["doc_id"].dataType.simpleString()
    placed = stored(known.mapInArrow(place, f"doc_id {kind}, embedding array<double>, cell long, far double"), f"{work_dir(spark, 'cells')}/placed")
    of_cell = placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    points = spark.createDataFrame([(k, c) for k, c in enumerate(shared.value.tolist())], "cell long, centre array<double>")
    heads = points.join(of_cell, "cell").withColumn("parts", F.ceil(F.col("n") / F.lit(PART_ROWS)))
    heads = stored(heads.select("cell", "centre", "radius", "n", "parts"), f"{full}/centres")
    parts = placed.join(F.broadcast(heads.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    parts.select("cell", "part", "doc_id", "embedding").repartition("cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{full}/vectors")
    versions.commit(base, {"form": FORM, "folders": [folder]})
    return Cells(spark, versions.path, folder)


def open_cells(spark: SparkSession, path: str) -> Cells | None:
    """The index at path, or None where there is none of this form."""
    _, record = Versions(spark, path).latest()
    return Cells(spark, path.rstrip("/"), record["folders"][0]) if record.get("form") == FORM else None


def top_k(queries: DataFrame, index: Cells, k: int | None = TOP_K) -> DataFrame:
    """qid, rank, doc_id, distance (squared) of the k nearest vectors for each of queries(qid, embedding)."""
    return search(queries, index, k).hits


def search(queries: DataFrame, index: Cells, k: int | None = TOP_K) -> Found:
    """The exact k nearest, ties by doc_id. Queries of another length than the index's vectors have no hits."""
    k = k or TOP_K
    spark, path = index.spark, work_dir(index.spark, "cell-search")
    heads = index.centres.collect()  # CENTRES at most
    size = len(heads[0]["centre"]) if heads else 0
    asked = usual(queries, "qid").filter(F.size("embedding") == size)
    # each query is one, also where ids are repeated
    asked = stored(asked.withColumn("q", F.monotonically_increasing_id()), f"{path}/asked")
    shared = spark.sparkContext.broadcast((np.array([h["cell"] for h in heads]), np.array([h["centre"] for h in heads], float).reshape(len(heads), size), np.array([h["radius"] for h in heads])))

    def bounds(batches):
        cell, centres, radius = shared.value
        for batch in batches:
            x = matrix(batch.column(1), batch.num_rows)
            if not len(x) or not len(cell):
                continue
            # differences a query at a time: exact where queries lie on centres
            far = np.stack([np.sqrt(((centres - row) ** 2).sum(1)) for row in x])
            low = np.maximum(0.0, far * (1 - SLACK) - radius * (1 + SLACK))
            place = np.argsort(np.argsort(low, axis=1, kind="stable"), axis=1)
            q = np.repeat(batch.column(0).to_numpy(), len(cell))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.tile(cell, len(x))), pa.array(low.ravel()), pa.array(place.ravel())], names=["q", "cell", "low", "place"])

    ways = stored(asked.select("q", "embedding").mapInArrow(bounds, "q long, cell long, low double, place long"), f"{path}/ways")
    first = stored(compared(ways.filter(F.col("place") < FIRST), asked, index, k), f"{path}/first")
    worst = best(first, k).groupBy("q").agg(F.max("distance").alias("limit"), F.count("*").alias("n"))
    later = ways.filter(F.col("place") >= FIRST).join(worst, "q", "left")
    open_ = F.col("n").isNull() | (F.col("n") < k) | (F.col("low") * F.col("low") <= F.col("limit") * (1 + SLACK) + 10.0**-DIGITS)
    later = stored(later.filter(open_).select("q", "cell"), f"{path}/later")
    second = stored(compared(later, asked, index, k), f"{path}/second")
    hits = best(first.unionByName(second), k).join(asked.select("q", "qid"), "q").select("qid", "rank", "doc_id", "distance")
    sizes = index.centres.select("cell", "n")
    read = ways.filter(F.col("place") < FIRST).select("q", "cell").unionByName(later).join(F.broadcast(sizes), "cell").groupBy("q").agg(F.sum("n").alias("n"))
    return Found(hits, read.join(asked.select("q", "qid"), "q").select("qid", "n"))


@dataclass(frozen=True)
class Tables:
    """What compared() needs of an index."""

    centres: DataFrame
    vectors: DataFrame


def scan(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The same without an index: slices of queries meet all parts of the vectors of their length, by a shuffle of both. For query sets too large to be sent."""
    path = work_dir(corpus.sparkSession, "vector-scan")
    length = F.size("embedding").cast("long").alias("cell")
    asked = stored(usual(queries, "qid").withColumn("q", F.monotonically_increasing_id()), f"{path}/asked")
    rows = usual(corpus, "doc_id").select(length, "doc_id", "embedding")
    heads = stored(rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(PART_ROWS)).alias("parts")), f"{path}/lengths")
    # a row's part goes by all of it, so that rows without id or of one id are dealt too
    dealt = rows.join(F.broadcast(heads), "cell").withColumn("part", F.pmod(F.xxhash64("doc_id", "embedding"), F.col("parts")))
    near = stored(compared(asked.select("q", length), asked, Tables(heads, dealt), k), f"{path}/near")
    return best(near, k).join(asked.select("q", "qid"), "q").select("qid", "rank", "doc_id", "distance")


def best(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("distance", "doc_id")
    return near.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def compared(ways: DataFrame, asked: DataFrame, index: Cells | Tables, k: int) -> DataFrame:
    """q, doc_id, distance: the k nearest vectors of each part of the cells that ways(q, cell) leads to."""
    heads = index.centres.select("cell", "parts")
    slices = ways.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(SLICE)).alias("slices"))  # a row for each cell
    at, each = ["cell", "part", "slice"], lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = ways.join(F.broadcast(slices), "cell").withColumn("slice", F.pmod(F.xxhash64("q"), F.col("slices"))).join(F.broadcast(heads), "cell").withColumn("part", each("parts"))
    left = dealt.select("q", *at).join(asked.select("q", "embedding"), "q")
    right = index.vectors.join(F.broadcast(slices), "cell").withColumn("slice", each("slices")).select(*at, "doc_id", "embedding")
    kind = right.schema["doc_id"].dataType.simpleString()

    def near(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        n, m = queries.num_rows, vectors.num_rows
        if not n or not m:
            return pa.table({"q": pa.array([], pa.int64()), "doc_id": vectors["doc_id"].slice(0, 0), "distance": pa.array([], pa.float64())})
        vectors = vectors.take(pc.sort_indices(vectors["doc_id"], null_placement="at_start"))
        x, y = matrix(queries["embedding"].combine_chunks(), n), matrix(vectors["embedding"].combine_chunks(), m)
        size, out_q, out_v, out_d = (y * y).sum(1), [], [], []
        for row, q in zip(x, queries["q"].to_pylist(), strict=True):
            own = row @ row
            rough = own + size - 2 * y @ row
            slack = 1e-12 * (own + size) * len(row) + 10.0**-DIGITS  # what rounding and the product's error may hide
            upper = np.partition(rough + slack, k - 1)[k - 1] if m > k else np.inf
            some = np.flatnonzero(rough - slack <= upper)
            exact = np.round(((y[some] - row) ** 2).sum(1), DIGITS)
            top = np.argsort(exact, kind="stable")[:k]  # vectors are in order of doc_id
            out_q += [q] * len(top)
            out_v += some[top].tolist()
            out_d += exact[top].tolist()
        return pa.table({"q": pa.array(out_q, pa.int64()), "doc_id": vectors["doc_id"].take(pa.array(out_v, pa.int64())), "distance": pa.array(out_d, pa.float64())})

    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(near, f"q long, doc_id {kind}, distance double")
