"""Fusion of two rankings: min-max normalisation, then a weighted sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

W_BM25, W_VEC, BM25_K, VEC_K, TOP_K = 0.7, 0.3, 10, 10, 3
DIGITS = 9


def normalized(score: Column, by: str, higher_is_better: bool = True) -> Column:
    """Scores of one result list onto 0..1; equal ones become 1, and where lower is better the result is turned round after that (so equal ones become 0)."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    x = F.when(high == low, F.lit(1.0)).otherwise((score - low) / F.when(high != low, high - low))
    return x if higher_is_better else 1.0 - x


def fuse(bm25: DataFrame, vec: DataFrame, w_bm25: float = W_BM25, w_vec: float = W_VEC, top_k: int = TOP_K) -> DataFrame:
    """qid, rank, doc_id, bm25_score, vec_score, combined_score from bm25(qid, rank, doc_id, score) and vec(qid, rank, doc_id, distance).

    A document missing on one side has 0 there. Ties keep BM25 order, then vector order. top_k 0 means the default.
    """
    left = bm25.select("qid", "doc_id", F.col("rank").alias("_r1"), normalized(F.col("score"), "qid").alias("b"))
    right = vec.select("qid", "doc_id", F.col("rank").alias("_r2"), normalized(F.col("distance"), "qid", False).alias("v"))
    both = left.join(right, ["qid", "doc_id"], "full").withColumns({"bm25_score": F.coalesce("b", F.lit(0.0)), "vec_score": F.coalesce("v", F.lit(0.0))})
    both = both.withColumn("combined_score", F.round(w_bm25 * F.col("bm25_score") + w_vec * F.col("vec_score"), DIGITS))
    order = Window.partitionBy("qid").orderBy(F.desc("combined_score"), F.asc_nulls_last("_r1"), F.asc_nulls_last("_r2"), "doc_id")
    ranked = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= (top_k or TOP_K))
    return ranked.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", "bm25_score", "vec_score", "combined_score")
