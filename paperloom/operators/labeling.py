"""Automatic retrieval labels: confidence of the best hit, and whether it holds the answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.prompts import chooser_prompt
from paperloom.functions.text import choice_at, normalized
from paperloom.operators.bm25 import sent
from paperloom.operators.models import chosen_documents
from paperloom.workspace import stored, work_dir

RATIO = 1.5
#: Characters of a candidate that a chooser sees.
SNIPPET = 200


def oracle_query(paragraph: Column, question: Column, choices: Column, answer: Column) -> Column:
    """The query that knows the answer; a number outside the choices stands for itself."""
    text = F.coalesce(choice_at(choices, answer), answer.cast("string"), F.lit(""))
    return normalized(F.concat_ws(" ", paragraph, question, F.concat(F.lit("정답: "), text)))


def ratios(hits: DataFrame) -> DataFrame:
    """qid, top1, top2, n of hits(qid, rank, score)."""
    return hits.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("top2"), F.count("*").alias("n"))


def confident(top1: Column, top2: Column, threshold: float = RATIO) -> Column:
    """One score is sure; a second one of 0 or less leaves the first's sign; else their ratio decides."""
    return F.when(top2.isNull(), True).when(top2 <= 0, top1 > 0).otherwise(top1 / F.when(top2 > 0, top2) >= threshold)


def holds_answer(answer: Column, *parts: Column) -> Column:
    """Whether the lower-cased answer occurs in the candidate's parts."""
    return F.contains(F.lower(F.concat_ws(" ", *parts)), F.lower(answer))


def labels_with_fallback(hits: DataFrame, answers: DataFrame, corpus: DataFrame, queries: DataFrame, choose: Callable[[Column], Column], threshold: float = RATIO, candidates: int = 5, limit: int = 2) -> DataFrame:
    """qid, gold_doc_ids and method for each of queries(qid, text): the sure best hit, else what a chooser takes from the first candidates.

    choose turns prompts into its answers, JSON lists of ids, and sees uncertain queries only. At most limit ids stay;
    an empty or unreadable answer is 'uncertain' and has none. Candidates are rank, id, title and the first characters of the body.
    """
    path = work_dir(hits.sparkSession, "labels")
    hits = stored(hits, f"{path}/hits")
    sure = stored(auto_label(hits, answers, corpus, threshold), f"{path}/sure")
    left = queries.select("qid", "text").join(sure.filter("method = 'auto_ratio'").select("qid"), "qid", "left_anti")
    shown = corpus.join(sent(hits.filter(F.col("rank") <= candidates).join(left.select("qid"), "qid")), "doc_id")
    line = F.struct("rank", F.col("doc_id").cast("string").alias("doc_id"), "title", F.substring("body", 1, SNIPPET).alias("snippet"))
    listed = shown.groupBy("qid").agg(F.array_sort(F.collect_list(line)).alias("shown"))  # a few a query
    asked = left.join(listed, "qid").withColumn("prompt", chooser_prompt(F.col("text"), F.col("shown"), limit))
    chosen = asked.withColumn("ids", chosen_documents(choose(F.col("prompt")), limit)).select("qid", "ids")
    both = queries.select("qid").join(sure.filter("method = 'auto_ratio'"), "qid", "left").join(chosen, "qid", "left")
    none = F.array().cast("array<string>")
    ids = F.when(F.col("gold_doc_id").isNotNull(), F.array(F.col("gold_doc_id").cast("string"))).otherwise(F.coalesce("ids", none))
    method = F.when(F.col("gold_doc_id").isNotNull(), "auto_ratio").when(F.size(ids) > 0, "gpt_fallback").otherwise("uncertain")
    return both.select("qid", ids.alias("gold_doc_ids"), method.alias("method"))


def auto_label(hits: DataFrame, answers: DataFrame, corpus: DataFrame, threshold: float = RATIO) -> DataFrame:
    """qid, gold_doc_id, method: the best hit where it is confident and holds the answer, else 'uncertain'.

    hits(qid, rank, doc_id, score), answers(qid, answer_text), corpus(doc_id, title, body). The hits go to the bodies, not these to them.
    """
    hits = stored(hits, work_dir(hits.sparkSession, "labeled-hits"))
    best = corpus.join(sent(hits.filter("rank = 1").select("qid", "doc_id")), "doc_id").join(answers, "qid").join(ratios(hits), "qid")
    sure = confident(F.col("top1"), F.col("top2"), threshold) & holds_answer(F.col("answer_text"), F.col("title"), F.col("body"))
    return best.select("qid", F.when(sure, F.col("doc_id")).alias("gold_doc_id"), F.when(sure, "auto_ratio").otherwise("uncertain").alias("method"))
