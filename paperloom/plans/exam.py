"""The life of an exam table: parse, gate, retrieve, augment, prompt, score, write. Models are column functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import literals, prompts
from paperloom.operators import bm25, context, corpus, hybrid, metrics, models, sampling, vectors

ColumnModel = Callable[[Column], Column]


@dataclass(frozen=True)
class Settings:
    """Defaults as configured for production runs."""

    seed: int = 42
    train_share: float = 0.8
    template: str = "base"
    template_folder: str | None = None
    retrieve: bool = False
    bm25_k: int = hybrid.BM25_K
    vec_k: int = hybrid.VEC_K
    top_k: int = hybrid.TOP_K
    w_bm25: float = hybrid.W_BM25
    w_vec: float = hybrid.W_VEC


def retrieved(records: DataFrame, documents: DataFrame, settings: Settings, embedded: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """qid, rank, doc_id for records(id, paragraph, question). embedded: vectors of records (qid, embedding) and documents (doc_id, embedding); without it, BM25 alone ranks."""
    asked = records.select(F.col("id").alias("qid"), context.query_text(F.col("paragraph"), F.col("question")).alias("text"))
    hits = bm25.build(documents.select("doc_id", "text")).top_k(asked, settings.bm25_k if embedded else settings.top_k)
    if embedded is None:
        return hits.select("qid", "rank", "doc_id")
    queries, dense = embedded
    return hybrid.fuse(hits, vectors.top_k(queries, dense, settings.vec_k), settings.w_bm25, settings.w_vec, settings.top_k).select("qid", "rank", "doc_id")


def with_documents(exams: DataFrame, raw_corpus: DataFrame, gates: tuple[ColumnModel, ColumnModel], settings: Settings, embedded: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """exams with documents and augmented paragraphs where both gates answer A. Only gated records are searched for."""
    first, second = prompts.gate_prompts(F.col("paragraph"), F.col("question"), F.col("choices"))
    passed = exams.select("id", "paragraph", "question", first.alias("_p1"), second.alias("_p2")).withColumn("_a", gates[0](F.col("_p1"))).filter("_a = 'A'")
    passed = passed.withColumn("_b", gates[1](F.col("_p2"))).filter("_b = 'A'").select("id", "paragraph", "question")
    searchable = corpus.searchable(raw_corpus)
    found = context.assembled(retrieved(passed, searchable, settings, embedded), searchable.select("doc_id", "title", "body"))
    joined = exams.drop("documents").join(found.withColumnRenamed("qid", "id"), "id", "left")
    return joined.withColumn("paragraph", context.augmented_paragraph(F.col("paragraph"), F.col("documents")))


def inference(raw: DataFrame, scorer: ColumnModel, settings: Settings, raw_corpus: DataFrame | None = None, gates: tuple[ColumnModel, ColumnModel] | None = None) -> DataFrame:
    """id, answer of raw (schemas.EXAM_RAW), in order of id. scorer: messages to an array of choice scores."""
    exams = literals.flattened(raw)
    if settings.retrieve:
        if raw_corpus is None or gates is None:
            raise ValueError("retrieval needs a corpus and two gates")
        exams = with_documents(exams, raw_corpus, gates, settings)
    asked = prompts.chat_messages(exams, settings.template, with_answer=False, folder=settings.template_folder)
    return models.predictions(asked.withColumn("_scores", scorer(F.col("messages"))), F.col("_scores")).orderBy("id")


def training_set(raw: DataFrame, settings: Settings) -> DataFrame:
    """id, answer and messages, with the answer as last turn, of the training part."""
    parts = sampling.train_test_split(raw, "id", settings.train_share, settings.seed).filter("split = 'train'").drop("split")
    return prompts.chat_messages(literals.flattened(parts), settings.template, folder=settings.template_folder).select("id", "answer", "messages")


def run(mode: str, raw: DataFrame, settings: Settings, scorer: ColumnModel | None = None, **retrieval) -> DataFrame:
    """One of the modes: 'train' gives the training set, 'evaluate' the metrics' row, 'inference' the answers."""
    if mode == "train":
        return training_set(raw, settings)
    if mode not in ("evaluate", "inference"):
        raise ValueError(f"no mode {mode!r}; there are train, evaluate and inference")
    if scorer is None:
        raise ValueError(f"mode {mode} needs a scorer")
    return evaluation(raw, scorer, settings)[1] if mode == "evaluate" else inference(raw, scorer, settings, **retrieval)


def evaluation(raw: DataFrame, scorer: ColumnModel, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Rows of the held-out part with answer, predict and correct, and their accuracy and macro-F1. Predictions join on id."""
    parts = sampling.train_test_split(raw, "id", settings.train_share, settings.seed)
    held = parts.filter("split = 'test'").drop("split")
    truth = literals.flattened(held).select("id", "answer")
    rows = metrics.marked(truth.join(inference(held, scorer, settings).withColumnRenamed("answer", "predict"), "id", "left"))
    return rows, metrics.accuracy(rows).crossJoin(metrics.macro_f1(rows))  # one row each
