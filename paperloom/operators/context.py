"""Retrieved context for records: gate, assembly, augmentation, gold contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.fixed import CONTEXT_PREFACE, NO_TITLE
from paperloom.functions.text import stripped
from paperloom.operators.bm25 import sent
from paperloom.workspace import stored, work_dir

#: Separators. The preface says three for any number of documents.
SEPARATOR, MARK = "\n\n---\n\n", "\n\n[CONTEXT]\n"


def query_text(paragraph: Column, question: Column) -> Column:
    return stripped(F.concat(F.coalesce(paragraph, F.lit("")), F.lit("\n"), F.coalesce(question, F.lit(""))))


def assembled(hits: DataFrame, corpus: DataFrame, preface: str = CONTEXT_PREFACE) -> DataFrame:
    """qid and documents: the hits' texts in order of rank, numbered. hits(qid, rank, doc_id) are top-k lists, which go to the bodies; corpus(doc_id, title, body)."""
    hits = stored(hits.select("qid", "rank", "doc_id"), work_dir(hits.sparkSession, "context-hits"))
    rows = corpus.join(sent(hits), "doc_id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "body"))).alias("x"))
    parts = F.transform("x", lambda e, i: F.concat(F.lit("#### "), (i + 1).cast("string"), F.lit(". "), F.coalesce(e["title"], F.lit(NO_TITLE)), F.lit("\n"), F.coalesce(e["body"], F.lit(""))))
    return rows.select("qid", F.concat(F.lit(preface), F.array_join(parts, SEPARATOR)).alias("documents"))


def augmented_paragraph(paragraph: Column, documents: Column) -> Column:
    """The paragraph, with the documents after it where there are any."""
    return F.when(documents.isNotNull() & (documents != ""), F.concat(F.coalesce(paragraph, F.lit("")), F.lit("\n\n"), documents)).otherwise(paragraph)


def gated(records: DataFrame, first: Column, second: Column, retrieved: DataFrame) -> DataFrame:
    """records with documents, null unless both tests hold. retrieved(qid, documents) joins on id.

    The second test runs on what passed the first: the filter stands between the two.
    """
    passed = records.filter(first).filter(second).select("id").join(retrieved.withColumnRenamed("qid", "id"), "id")
    return records.join(passed, "id", "left")


def gold_context(records: DataFrame, labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """records(id, paragraph) with their gold documents appended, in the order of the label's list; unknown ids are left out.

    labels(id, gold_doc_ids), corpus(doc_id, title, body). Only ids travel until the corpus join.
    """
    wanted = labels.select("id", F.posexplode(F.coalesce("gold_doc_ids", F.array().cast("array<string>"))).alias("pos", "doc_id"))
    found = wanted.join(corpus, "doc_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id", "title", "body"))).alias("x"))
    text = F.array_join(F.transform("x", lambda e: F.concat(F.lit("["), e["doc_id"], F.lit("] "), F.coalesce(e["title"], F.lit("")), F.lit("\n"), F.coalesce(e["body"], F.lit("")))), "\n\n")
    joined = records.join(found.select("id", text.alias("context")), "id", "left")
    return joined.withColumn("paragraph", F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.coalesce("paragraph", F.lit("")), F.lit(MARK), F.col("context"))).otherwise(F.col("paragraph")))
