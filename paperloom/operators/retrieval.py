"""Retrievers with one contract: build once, then answer a whole table of queries.

``retrieve(queries, top_k)`` takes queries(qid, text) and gives search results: qid, rank, doc_id, title, score,
metadata and content. A top_k of 0 or None means the retriever's own default.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.log import get_logger
from paperloom.operators import bm25, cells, context, hybrid, vectors
from paperloom.registry import RETRIEVERS
from paperloom.workspace import stored, work_dir

#: Turns rows(key, text) into rows(key, embedding), where a row without vector is one that failed; it may have further columns, as an error.
Embedder = Callable[[DataFrame], DataFrame]
#: What an embedder raises where it isn't there. Other errors are mistakes, and pass.
UNAVAILABLE = (ConnectionError, TimeoutError, ImportError, FileNotFoundError, PermissionError)


def results(hits: DataFrame, corpus: DataFrame, score: str = "score") -> DataFrame:
    """hits(qid, rank, doc_id, score) with title, metadata and content of corpus(doc_id, title, body, ...); metadata holds the corpus's further columns.

    Hits are top-k lists, and go to the bodies.
    """
    hits = stored(hits, work_dir(hits.sparkSession, "results-hits"))
    more = [c for c in corpus.columns if c not in ("doc_id", "title", "body", "text")]
    side = corpus.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.struct("doc_id", "title", *more).alias("metadata"), F.col("body").alias("content"))
    return side.join(bm25.sent(hits), "doc_id").select("qid", "rank", "doc_id", "title", F.col(score).alias("score"), "metadata", "content")


class Retriever(ABC):
    """corpus: doc_id, title, text (searched), body (shown), and further columns."""

    def __init__(self, corpus: DataFrame, default_k: int):
        self.corpus, self.default_k, self._built = corpus, default_k, False

    @abstractmethod
    def build_index(self) -> None: ...

    @abstractmethod
    def hits(self, queries: DataFrame, k: int) -> DataFrame:
        """qid, rank, doc_id, score."""

    def ready(self) -> None:
        if not self._built:
            self.build_index()
            self._built = True

    def retrieve(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        if not isinstance(queries, DataFrame):
            raise TypeError("queries must be a DataFrame with qid and text")
        self.ready()
        return results(self.hits(queries, top_k or self.default_k), self.corpus)


@RETRIEVERS.register("bm25")
class Bm25Retriever(Retriever):
    def __init__(self, corpus: DataFrame, default_k: int = bm25.TOP_K, path: str | None = None):
        super().__init__(corpus, default_k)
        self.path = path

    def build_index(self) -> None:
        self.index = bm25.build(self.corpus.select("doc_id", "text"), self.path)

    def hits(self, queries: DataFrame, k: int) -> DataFrame:
        return self.index.top_k(queries, k)


@RETRIEVERS.register("vector")
class VectorRetriever(Retriever):
    """score is a distance: lower is better. Documents and queries without a vector have no hits.

    With a path the vectors are stored there once, in cells, and searched by cells; without one they are scanned.
    """

    def __init__(self, corpus: DataFrame, embed: Embedder, default_k: int = vectors.TOP_K, path: str | None = None):
        super().__init__(corpus, default_k)
        self.embed, self.path = embed, path

    def vectors_of(self, rows: DataFrame, key: str) -> DataFrame:
        """key and embedding of those rows(key, text) that have one."""
        found = self.embed(rows.select(F.col(key).alias("key"), "text"))
        return found.filter("embedding is not null").select(F.col("key").alias(key), "embedding")

    def build_index(self) -> None:
        spark = self.corpus.sparkSession
        if self.path:
            self.index = cells.open_cells(spark, self.path) or cells.build(self.vectors_of(self.corpus, "doc_id"), self.path)
        else:
            self.index = self.vectors_of(self.corpus, "doc_id")

    def near(self, asked: DataFrame, k: int) -> DataFrame:
        """qid, rank, doc_id, distance for asked(qid, embedding)."""
        return cells.top_k(asked, self.index, k) if isinstance(self.index, cells.Cells) else vectors.top_k(asked, self.index, k)

    def hits(self, queries: DataFrame, k: int) -> DataFrame:
        return self.near(self.vectors_of(queries, "qid"), k).withColumnRenamed("distance", "score")


@RETRIEVERS.register("hybrid")
class HybridRetriever(Retriever):
    """BM25 and vectors fused. A query without a vector has BM25's hits and scores; so have all where the embedder isn't there."""

    def __init__(self, lexical: Bm25Retriever, dense: VectorRetriever | None, default_k: int = hybrid.TOP_K, weights: tuple[float, float] = (hybrid.W_BM25, hybrid.W_VEC)):
        super().__init__(lexical.corpus, default_k)
        self.lexical, self.dense, self.weights = lexical, dense, weights

    def build_index(self) -> None:
        self.lexical.ready()

    def vectors_of(self, queries: DataFrame) -> DataFrame | None:
        """qid and embedding of the queries that have one, stored, as they are asked for twice; None without an embedder."""
        if self.dense is None:
            return None
        try:
            self.dense.ready()
            found = self.dense.vectors_of(queries, "qid")
        except UNAVAILABLE as e:
            get_logger().warning("dense retrieval is left out: %s", e)
            return None
        return stored(found, work_dir(queries.sparkSession, "query-vectors"))

    def hits(self, queries: DataFrame, k: int) -> DataFrame:
        asked = self.vectors_of(queries)
        if asked is None:
            return self.lexical.hits(queries, k)
        near = stored(self.lexical.hits(queries, max(k, hybrid.BM25_K)), work_dir(queries.sparkSession, "lexical-hits"))
        alone = near.join(asked.select("qid"), "qid", "left_anti").filter(F.col("rank") <= k)
        fused = hybrid.fuse(near.filter(F.col("rank") <= hybrid.BM25_K).join(asked.select("qid"), "qid", "left_semi"), self.dense.near(asked, hybrid.VEC_K), *self.weights, k)
        return fused.withColumnRenamed("combined_score", "score").select("qid", "rank", "doc_id", "score").unionByName(alone)


class RagPipeline:
    """Retrieval and context in one step, for a batch or one text."""

    def __init__(self, retriever: Retriever, top_k: int | None = None):
        self.retriever, self.top_k = retriever, top_k

    def run_batch(self, queries: DataFrame) -> DataFrame:
        """qid and documents, the assembled context, for queries(qid, text)."""
        found = self.retriever.retrieve(queries, self.top_k)
        return context.assembled(found.select("qid", "rank", "doc_id"), self.retriever.corpus.select("doc_id", "title", "body"))

    def run(self, text: str) -> str | None:
        row = self.run_batch(self.retriever.corpus.sparkSession.createDataFrame([(0, text)], "qid long, text string")).first()
        return row["documents"] if row else None
