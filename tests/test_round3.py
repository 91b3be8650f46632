"""Numbering, page layout, manifests, resumable generation, failures by row, and vectors in cells."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import cells, exam_text, generation, layout, models, numbering, retrieval, vectors
from paperloom.sources import files, remote, store


# ---------------------------------------------------------------- numbering

@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_are_dense_and_in_order(spark, partitions):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", None, "z"]), k) for k in range(500)] + [("same", 1)] * 5
    rng.shuffle(rows)
    got = numbering.numbered(spark.createDataFrame(rows, "a string, b int").repartition(partitions), ["a", "b"], start=10).collect()
    assert sorted(r.n for r in got) == list(range(10, 515))
    key = lambda r: (r[0] is not None, r[0] or "", r[1])
    assert [key(r) for r in sorted(got, key=lambda r: r.n)] == sorted(map(key, rows))
    assert numbering.numbered(spark.createDataFrame([], "a string, b int"), ["a"]).count() == 0


def test_ids_keep_their_digits(spark):
    rows = spark.createDataFrame([(f"d{k:02d}", k) for k in range(12)], "doc string, q_num int")
    plain, wide = (sorted(r.id for r in exam_text.with_ids(rows, "g-", 95, width=w).collect()) for w in (0, 2))
    assert plain == wide == sorted(f"g-{95 + k}" for k in range(12))
    assert exam_text.with_ids(rows, "g-", width=4).filter("q_num = 7").first().id == "g-0007"


# ---------------------------------------------------------------- layout

def test_page_layout(spark):
    """Left before right, lines by a chain of small steps, words in a line by place, close ones joined."""
    word = lambda x0, x1, top, text, page=1: ("d", page, 100.0, float(x0), float(x1), float(top), text)
    rows = [
        word(60, 70, 10, "right"), word(20, 30, 12, "two"), word(5, 15, 10, "one"), word(34, 40, 14.5, "three"), word(5, 15, 19, "next"), word(16, 20, 19, "line"),
        word(80, 95, 11, "end"), word(40, 55, 30, "left"), word(46, 56, 30, "middle"), word(70, 80, 5, "only right", 2), ("d", 3, 100.0, None, 1.0, 1.0, "no place"), word(1, 2, 3, "", 3),
    ]
    rng = random.Random(2)
    rng.shuffle(rows)
    got = {r.page: r.text for r in layout.page_texts(spark.createDataFrame(rows, "doc string, page int, width double, x0 double, x1 double, top double, text string")).collect()}
    assert got == {1: "one two three\nnextline\nleft\nright end\nmiddle", 2: "\nonly right"}


# ---------------------------------------------------------------- manifest

def test_manifest_is_read_by_tasks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbf\xec\xa7\x80\xeb\xac\xb8")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00")
    rows = [("ok", str(tmp_path / "a.txt"), f"file://{tmp_path}/a.txt"), ("half", str(tmp_path / "a.txt"), str(tmp_path / "none.txt")), ("bad", str(tmp_path / "bad.txt"), None), ("dir", str(tmp_path), "nosuch://x/y")]
    got = {r.name: r for r in files.read_pairs(spark.createDataFrame(rows, "name string, exam string, sheet string")).collect()}
    assert (got["ok"].exam_text, got["ok"].sheet_text, got["ok"].error) == ("지문", "지문", None)
    assert got["half"].exam_text == "지문" and got["half"].sheet_text is None and "none.txt: FileNotFoundError" in got["half"].error
    assert got["bad"].exam_text is None and "UnicodeDecodeError" in got["bad"].error and "no path" in got["bad"].error
    assert got["dir"].exam_text is None and len(got["dir"].error.split("\n")) == 2


def test_files_are_whole_or_absent(tmp_path):
    path = f"file://{tmp_path}/x/y.bin"
    assert not remote.exists(path)
    remote.write_bytes(path, b"abc")
    assert remote.exists(path) and remote.read_bytes(path) == b"abc" and [p.name for p in (tmp_path / "x").iterdir()] == ["y.bin"]


# ---------------------------------------------------------------- generation

def counting(folder, fail=lambda prompt: False, die=None):
    """A client that leaves a file for each call, and ends its process at one prompt."""

    def client():
        import os
        import uuid

        def call(prompt):
            open(f"{folder}/{prompt}-{uuid.uuid4().hex}", "w").close()
            if prompt == die and not os.path.exists(f"{folder}.died"):
                open(f"{folder}.died", "w").close()
                raise SystemExit("stopped midway")
            if fail(prompt):
                raise TimeoutError("busy")
            return f"said {prompt}"

        return call

    return client


def test_a_stopped_job_asks_nothing_twice(spark, tmp_path):
    calls, log = tmp_path / "calls", f"file://{tmp_path}/log"
    calls.mkdir()
    rows = spark.createDataFrame([(k, f"p{k % 50}") for k in range(60)] + [(100, None)], "id int, prompt string").repartition(3)
    with pytest.raises(Exception, match="stopped midway"):  # local mode tries a task once
        generation.generated_with_log(rows, counting(str(calls), die="p33"), log, every=1, tries=1)
    before = {p.name.split("-")[0] for p in calls.iterdir()}
    assert "p33" in before
    got = generation.generated_with_log(rows, counting(str(calls)), log, every=1, tries=1).collect()
    assert sorted((r.id, r.output, r.error) for r in got) == sorted([(k, f"said p{k % 50}", None) for k in range(60)] + [(100, None, None)])
    asked = [p.name.split("-")[0] for p in calls.iterdir()]
    # answers of tasks that were cut off in the middle of a prompt are the only ones that may come twice
    twice = {p for p in asked if asked.count(p) > 1}
    assert set(asked) == {f"p{k}" for k in range(50)} and twice <= before and "p33" in twice and len(twice) <= 4
    generation.generated_with_log(rows, counting(str(calls)), log, every=1)
    assert len(list(calls.iterdir())) == len(asked)


def test_failed_prompts_are_asked_again(spark, tmp_path):
    calls, log = tmp_path / "calls", f"file://{tmp_path}/log"
    calls.mkdir()
    rows = spark.createDataFrame([(k, f"p{k}") for k in range(10)], "id int, prompt string")
    first = generation.generated_with_log(rows, counting(str(calls), fail=lambda p: p in ("p3", "p4")), log, every=4, tries=2, wait=0.0).collect()
    assert {r.id for r in first if r.error} == {3, 4} and all("TimeoutError: busy" in r.error for r in first if r.error) and len(list(calls.iterdir())) == 12
    again = generation.generated_with_log(rows, counting(str(calls)), log, every=4).collect()
    assert all(r.output == f"said p{r.id}" and r.error is None for r in again) and len(list(calls.iterdir())) == 14


def test_pace():
    now, slept = [0.0], []
    pace = generation.Pace(4.0, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(9):
        pace.wait()
    assert now[0] == pytest.approx(2.0) and len(slept) == 8
    generation.Pace(0.0, lambda: now[0], slept.append).wait()
    assert len(slept) == 8


# ---------------------------------------------------------------- failures by row

def test_one_bad_text_fails_alone(spark):
    def load():
        def model(texts):
            if any("bad" in x for x in texts):
                raise ValueError("can't")
            return texts.map(lambda x: [float(len(x))])

        return model

    rows = spark.createDataFrame([(k, "bad" if k % 7 == 3 else "x" * k) for k in range(100)], "key int, text string").repartition(2)
    got = {r.key: r for r in models.embedded_rows(rows, "text", load).collect()}
    assert all((got[k].embedding is None) == (k % 7 == 3) == (got[k].error == "ValueError: can't") for k in range(100))
    assert all(got[k].embedding == [float(k)] for k in range(100) if k % 7 != 3)
    short = models.embedded_rows(rows, "text", lambda: lambda texts: [[1.0]]).collect()
    assert all(r.embedding == [1.0] for r in short)  # halves down to single texts, of each of which one vector is right


def test_mistakes_of_an_embedder_pass(spark):
    """An absent embedder is left out, and asked again next time; another error is not hidden."""
    docs = spark.createDataFrame([(k, "T", t, t) for k, t in enumerate(["apple pie", "pear tart", "plum jam"])], "doc_id long, title string, text string, body string")
    asked = spark.createDataFrame([(7, "pear")], "qid long, text string")
    state = {"error": ConnectionError("down")}

    def embed(rows):
        if state["error"]:
            raise state["error"]
        return models.embedded_rows(rows, "text", lambda: lambda t: t.map(lambda x: [float("pear" in x)]))

    both = retrieval.HybridRetriever(retrieval.Bm25Retriever(docs), retrieval.VectorRetriever(docs, embed))
    assert both.retrieve(asked, 1).first().doc_id == 1
    state["error"] = None
    assert both.retrieve(asked, 3).count() == 3
    state["error"] = AttributeError("a mistake")
    with pytest.raises(AttributeError):
        both.retrieve(asked)


# ---------------------------------------------------------------- cells

def brute_nearest(queries, rows, k):
    out = []
    for q, x in queries:
        far = sorted((round(float(((np.array(y) - np.array(x)) ** 2).sum()), 9), i) for i, y in rows if y is not None and len(y) == len(x))
        out += [(q, rank, i, d) for rank, (d, i) in enumerate(far[:k], 1)]
    return out


def test_cells_equal_brute_force(spark, tmp_path, monkeypatch):
    """Clusters, copies and ties, vectors that don't count, cells in several parts, queries in several slices and with one id twice."""
    monkeypatch.setattr(cells, "PART_ROWS", 40)
    monkeypatch.setattr(cells, "SLICE", 5)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 4)) * 20
    rows = [(k, (middles[k % 12] + rng.normal(size=4)).round(2).tolist()) for k in range(900)] + [(1000 + k, middles[0].tolist()) for k in range(200)]
    queries = [(k, (middles[k % 12] + rng.normal(size=4)).tolist()) for k in range(60)] + [(99, middles[0].tolist())]
    odd = [(2000, None), (2001, [1.0]), (2002, []), (2003, [1.0, None, 2.0, 3.0])]
    index = cells.build(spark.createDataFrame(rows + odd, "doc_id int, embedding array<double>"), f"file://{tmp_path}/v", 24)
    asked = spark.createDataFrame([*queries, (100, [1.0]), (101, None)], "qid int, embedding array<double>")
    found = cells.search(asked, cells.open_cells(spark, f"file://{tmp_path}/v"), 7)
    assert sorted(map(tuple, found.hits.collect())) == sorted(brute_nearest(queries, rows, 7))
    read = {r.qid: r.n for r in found.read.collect()}
    assert sum(read.values()) < 0.4 * len(rows) * len(queries)  # cells that can't hold one of the nearest aren't read
    same = vectors.top_k(asked.filter("size(embedding) = 4"), spark.createDataFrame(rows, "doc_id int, embedding array<double>"), 7)
    assert sorted((r.qid, r.rank, r.doc_id) for r in same.collect()) == sorted((q, r, i) for q, r, i, _ in brute_nearest(queries, rows, 7))
    twice = cells.top_k(spark.createDataFrame([queries[0], queries[0]], "qid int, embedding array<double>"), index, 3)
    assert twice.count() == 6 and cells.top_k(asked.limit(1), index, 2000).count() == len(rows)


def test_cells_of_nothing(spark, tmp_path):
    path, none = f"file://{tmp_path}/v", spark.createDataFrame([], "doc_id int, embedding array<float>")
    assert cells.open_cells(spark, path) is None
    index = cells.build(none, path)
    assert cells.top_k(spark.createDataFrame([(1, [1.0])], "qid int, embedding array<float>"), index).count() == 0
    again = cells.build(spark.createDataFrame([(5, [1.0, 2.0])], "doc_id int, embedding array<float>"), path)
    assert [tuple(r) for r in cells.top_k(spark.createDataFrame([(1, [1.0, 0.0])], "qid int, embedding array<float>"), again, 0).collect()] == [(1, 1, 5, 4.0)]
    store.Versions(spark, path).commit(2, {"form": "another"})
    assert cells.open_cells(spark, path) is None


def test_vectors_are_stored_once(spark, tmp_path):
    docs = spark.createDataFrame([(k, "T", t, t) for k, t in enumerate(["apple", "pear"])], "doc_id long, title string, text string, body string")
    calls = []
    embed = lambda rows: calls.append(1) or models.embedded(rows, "text", lambda: lambda t: t.map(lambda x: [float(len(x))]))
    asked = spark.createDataFrame([(1, "pearl")], "qid long, text string")
    for n in (2, 3):
        got = retrieval.VectorRetriever(docs, embed, path=f"file://{tmp_path}/v").retrieve(asked, 1)
        assert [r.doc_id for r in got.select("doc_id").collect()] == [0] and len(calls) == n
    assert remote.exists(f"{tmp_path}/v")


# ---------------------------------------------------------------- metric, sinks, dataset

def test_training_metric(spark):
    from paperloom.operators import metrics

    labels = {"1": 0, "5": 4, " 3 \n": 2, "2<end_of_turn>\n4": 1, "6": 0, "12": 0, "": 0, "x": 0, None: 0}
    got = spark.createDataFrame([(t,) for t in labels], "t string").select("t", metrics.decoded_label(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == labels
    rows = [([[9.0] * 5, [0.0, 2.0, 1.0, 2.0, 0.0], [0.0] * 5], "2"), ([[0.0, 1.0, 3.0, 0.0, 0.0], [0.0] * 5], "3"), ([[0.0] * 5], "1")]
    table = spark.createDataFrame(rows, "logits array<array<double>>, label_text string")
    assert table.select(metrics.choice_logits(F.col("logits"), [1, 3]).alias("s")).collect()[0].s == [2.0, 2.0]
    assert metrics.training_metric(table, [0, 1, 2, 3, 4]).first().macro_f1 == pytest.approx((1 + 1 + 0) / 3)


def test_csv_with_bom_in_every_file(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), f'a "quoted", text {k}\nof two lines') for k in range(9)], "id string, problems string").repartition(3)
    files.write_csv(rows, f"file://{tmp_path}/b", bom=True)
    parts = list((tmp_path / "b").glob("part-*.csv"))
    assert len(parts) == 3 and all(p.read_bytes().startswith(b"\xef\xbb\xbfid,problems\n") for p in parts)
    assert sorted((r.id, r.problems) for r in files.read_csv(spark, f"file://{tmp_path}/b").collect()) == sorted(map(tuple, rows.collect()))


def test_dataset(spark, tmp_path):
    from paperloom.plans import dataset

    problems = '{"question": "q", "choices": ["a", "b"], "answer": 2}'
    files.write_csv(spark.createDataFrame([(str(k), "word " * k, problems) for k in range(10)], "id string, paragraph string, problems string"), f"file://{tmp_path}/d")
    data = dataset.ExamDataset(spark, f"file://{tmp_path}/d", share=0.7)
    raw = data.load_data()
    assert {k: v.count() for k, v in raw.items()} == {"train": 7, "test": 3}
    tokens = lambda: lambda texts: texts.map(lambda x: list(range(len(x.split()))))
    most = max(len(r.input_ids) for r in data.preprocess(tokens, 10**6)["train"].collect())
    cut = data.preprocess(tokens, most - 1)
    assert cut["train"].count() < 7 and cut["test"].count() == 3
    assert max(len(r.input_ids) for r in data.preprocess(tokens, 20)["test"].collect()) == 20
    with pytest.raises(TypeError):
        dataset.Dataset(spark, "x")
