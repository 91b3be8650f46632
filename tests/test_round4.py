"""Work that must stay bounded for one task as tables grow."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.operators import bm25, context, labeling, models, retrieval


def corpus(spark, n=600, words=300, seed=5):
    rng = random.Random(seed)
    names, weights = [f"w{k}" for k in range(words)], [1 / (k + 3) for k in range(words)]
    text_ = lambda most: " ".join(rng.choices(names, weights, k=rng.randrange(0, most)))
    docs = spark.createDataFrame([(i, text_(60)) for i in range(n)] + [(-1, None), (-2, "가나 다-라 é w1")], "doc_id long, text string")
    return docs, spark.createDataFrame([(f"q{k}", text_(12)) for k in range(30)], "qid string, text string")


def rows_of(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_index_is_built_in_tasks_of_bounded_tokens(spark, monkeypatch):
    """Twice the tokens are twice the tasks; a range lies in one of them, and its postings are not shuffled one by one."""
    docs, _ = corpus(spark)
    plain = bm25.build(docs)
    monkeypatch.setattr(bm25, "RANGE", 8)
    monkeypatch.setattr(bm25, "TASK_TOKENS", 500)
    index = bm25.build(docs)
    files = index.blocks.select("range", F.input_file_name().alias("file")).distinct()
    assert files.select("file").distinct().count() > 12 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert files.count() == files.select("range").distinct().count()
    assert rows_of(index.postings) == rows_of(plain.postings) and rows_of(index.terms) == rows_of(plain.terms) and index.size == plain.size
    for r in index.blocks.collect():
        least = {}
        for p in r.postings:
            least[p.tf] = min(p.dl, least.get(p.tf, p.dl))
        assert least == {x.tf: x.dl for x in r.levels} and r.n == len(r.postings)


@pytest.mark.parametrize("broadcast", [True, False])
def test_only_a_ranges_best_scores_leave_its_task(spark, monkeypatch, broadcast):
    """With k a range gives k scores of a query and ties, without it all; lots of queries and deleted documents change nothing."""
    docs, asked = corpus(spark)
    kept = docs.filter("doc_id % 5 != 0")
    want = bm25.build(kept)
    full, best = rows_of(want.matches(asked)), rows_of(want.top_k(asked, 3))
    monkeypatch.setattr(bm25, "RANGE", 64)
    monkeypatch.setattr(bm25, "LOT", 7)
    if not broadcast:
        monkeypatch.setattr(bm25, "BROADCAST_TERMS", 0)
    index = bm25.build(docs).delete(docs.filter("doc_id % 5 = 0").select("doc_id"))
    assert rows_of(index.matches(asked)) == full
    assert rows_of(index.top_k(asked, 3)) == best == rows_of(index.top_k(asked, 3, prune=True))
    some = index.matches(asked, k=3)
    assert set(rows_of(some)) <= set(full) and some.count() < len(full) / 3


def test_scores_are_summed_in_steps(monkeypatch):
    """A group whose postings and queries make more pairs than a step holds has the same scores."""
    rng = random.Random(3)
    posting = lambda: [{"doc_id": d, "tf": rng.randrange(1, 4), "dl": 5 + d} for d in rng.sample(range(20), 9)]
    asks = lambda: [{"qid": q, "weight": rng.random(), "least": -np.inf} for q in rng.sample(range(6), 3)]
    blocks = [{"segment": 0, "range": 2, "lot": 0, "postings": posting(), "asks": asks()} for _ in range(15)]
    blocks.append({"segment": 0, "range": 2, "lot": 0, "postings": [{"doc_id": 4, "tf": 0, "dl": 0}], "asks": None})
    want = {}
    for r in blocks[:-1]:
        for p in r["postings"]:
            for a in r["asks"]:
                if p["doc_id"] != 4:
                    key = (a["qid"], p["doc_id"])
                    want[key] = want.get(key, 0) + a["weight"] * p["tf"] * 2.5 / (p["tf"] + 1.5 * (0.25 + 0.75 * p["dl"] / 12))
    for step in (1, 40, 10**6):
        monkeypatch.setattr(bm25, "STEP", step)
        got = {(r["qid"], r["doc_id"]): r["score"] for r in bm25.scores_of(pa.Table.from_pylist(blocks), 1.5, 0.75, 12.0, None).to_pylist()}
        assert got == pytest.approx(want)


def test_a_tokenizer_gets_few_texts_at_a_time(spark):
    """A call has CALL_CHARS characters at most, or one text."""
    asked = []

    def model(texts: pd.Series) -> pd.Series:
        asked.append([len(x) for x in texts])
        return texts.map(lambda x: [len(x)] * 3)

    texts = pd.Series(["a" * n for n in [1000] * 700 + [models.CALL_CHARS + 1, 5, 7]])
    got = models.in_calls(model)(texts)
    assert [list(x) for x in got] == [[len(x)] * 3 for x in texts]
    assert len(asked) == 5 and all(sum(x) <= models.CALL_CHARS or len(x) == 1 for x in asked)
    assert len(models.in_calls(model)(pd.Series([], dtype=object))) == 0
    rows = spark.range(2000).select("id", F.lit(0).alias("answer"), F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content"))).alias("messages"))

    def count_batches():
        return lambda texts: pd.Series([[len(texts)]] * len(texts))

    most = models.tokenized(rows, count_batches, 10).agg(F.max(F.col("input_ids")[0])).first()[0]
    assert most <= 256


def test_hits_go_to_bodies(spark):
    """Bodies are not shuffled for a few hits, however large their table seems."""
    corpus = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("title"), F.col("id").cast("string").alias("body"))
    hits = spark.range(40).select((F.col("id") % 10).alias("qid"), (F.floor(F.col("id") / 10) + 1).cast("long").alias("rank"), (F.col("id") * 7).alias("doc_id"), (50.0 - F.col("id")).alias("score"))
    answers = spark.range(10).select(F.col("id").alias("qid"), (F.col("id") * 7).cast("string").alias("answer_text"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        for out, n in ((context.assembled(hits, corpus), 10), (retrieval.results(hits, corpus), 40)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and out.count() == n
        out = labeling.auto_label(hits, answers, corpus)
        assert "BroadcastHashJoin [doc_id" in out._jdf.queryExecution().executedPlan().toString() and out.count() == 10
    finally:
        spark.conf.set(key, before)
