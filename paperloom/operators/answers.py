"""Combining several models' answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_form(predictions: dict[str, DataFrame]) -> DataFrame:
    """id, model, answer of each model's predictions(id, answer)."""
    return reduce(DataFrame.unionByName, [df.select("id", F.lit(m).alias("model"), "answer") for m, df in predictions.items()])


def hard_vote(votes: DataFrame, tie_breaker: str) -> DataFrame:
    """id, answer: the most frequent answer; on a tie the tie breaker's own, which need not be among the tied.

    Ids are the tie breaker's. Missing answers don't count; a tie without its answer, or no answer at all, gives null.
    """
    ids = votes.filter(F.col("model") == tie_breaker).select("id", F.col("answer").alias("own"))
    counted = votes.filter("answer is not null").groupBy("id", "answer").agg(F.count("*").alias("n"))
    # the highest count, and the answers that have it: one row an id, without a sort
    best = counted.groupBy("id").agg(F.max(F.struct("n", "answer")).alias("high"), F.min(F.struct(-F.col("n"), "answer")).alias("low"))
    best = best.select("id", F.when(F.col("high.answer") == F.col("low.answer"), F.col("high.answer")).alias("mode"))
    return ids.join(best, "id", "left").select("id", F.coalesce("mode", "own").alias("answer"))


def agreement(votes: DataFrame, final: DataFrame) -> DataFrame:
    """model, agree, percent of final's ids; a missing answer disagrees."""
    total = final.agg(F.count("*").alias("total"))
    hit = votes.join(final.select("id", F.col("answer").alias("final")), "id").groupBy("model").agg(F.sum(F.when(F.col("answer") == F.col("final"), 1).otherwise(0)).alias("agree"))
    return hit.crossJoin(F.broadcast(total)).select("model", "agree", (F.col("agree") * 100.0 / F.nullif(F.col("total"), F.lit(0))).alias("percent"))


def route(labels: DataFrame, p1: DataFrame, p2: DataFrame, p3: DataFrame) -> DataFrame:
    """id, answer for ids in all four tables: label A and p1 = p2 gives p1, everything else p3."""
    name = lambda df, n: df.select("id", F.col("answer").alias(n))
    joined = labels.select("id", "label").join(name(p1, "p1"), "id").join(name(p2, "p2"), "id").join(name(p3, "p3"), "id")
    is_a = F.upper(F.regexp_replace("label", r"(?U)^\s+|\s+$", "")) == "A"
    return joined.select("id", F.when(is_a & (F.col("p1") == F.col("p2")), F.col("p1")).otherwise(F.col("p3")).alias("answer"))


def best_choice(scores):
    """The 1-based place of the highest score, the first of equals, as a Column."""
    return F.array_position(scores, F.array_max(scores)).cast("int")
