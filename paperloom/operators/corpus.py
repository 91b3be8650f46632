"""Corpus tables: append of unseen documents, and deduplication by key in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import augmented, markdown


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the one that comes first. One row a key is kept while counting, so a hot key is merged before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, "_row.*").select(*df.columns)


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the one that comes last."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, "_row.*").select(*df.columns)


def append_unseen(existing: DataFrame, new: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """existing and those rows of new whose key is in neither existing nor an earlier row of new."""
    unseen = first_wins(new, [key], [order]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(unseen.select(*existing.columns))


def append_counts(existing: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: n_existing, n_new, n_added and n_repeated of an append of new to existing."""
    fresh = new.select(key).distinct().join(existing.select(key), key, "left_anti")
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((existing, "n_existing"), (new, "n_new"), (fresh, "n_added"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).withColumn("n_repeated", F.col("n_new") - F.col("n_added"))  # one row each


def searchable(corpus: DataFrame) -> DataFrame:
    """doc_id, title, text (what an index sees) and body (its content as Markdown) of schemas.CORPUS."""
    keys = F.col("rag_matching_keywords")
    text: Column = augmented(F.col("search_text"), F.col("title"), F.col("aliases"), keys["quotes"], keys["related_terms"])
    return corpus.select("doc_id", "title", text.alias("text"), markdown(F.col("content")).alias("body"))
