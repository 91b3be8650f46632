"""Small tables with hand-computed answers: ties, nulls, empties."""

from __future__ import annotations

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.functions import literals, prompts, text
from paperloom.operators import answers, bm25, context, corpus, exam_text, hybrid, labeling, metrics, models, sampling, vectors
from paperloom.sources import files, store


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


# ---------------------------------------------------------------- text

@pytest.mark.parametrize(("raw", "want"), [(" a　b  \nc ", "a b c"), ("", ""), ("　", "")])
def test_normalized(spark, raw, want):
    assert one(spark, text.normalized(F.col("t")), t=raw) == want


def test_cleaned(spark):
    assert one(spark, text.cleaned(F.col("t")), t=" 。, (cid:12)가 　나(cid:3)\n다") == "가 나 다"


def test_tokens_split_hangul_from_latin(spark):
    assert one(spark, text.tokens(F.col("t")), t="가나AB12-é x") == ["가나", "AB12", "x"]


def test_augmented_skips_empty_parts_but_not_elements(spark):
    df = spark.createDataFrame([("", "t", ["a", ""], None, ["q"])], "s string, t string, a array<string>, k array<string>, r array<string>")
    assert df.select(text.augmented(F.col("s"), F.col("t"), F.col("a"), F.col("k"), F.col("r"))).first()[0] == "t a  q"


def test_markdown_keeps_order(spark):
    content = json.dumps({"z_key": "v", "a": ["p", "q"], "m": "[not a list"}, ensure_ascii=False)
    assert one(spark, text.markdown(F.col("t")), t=content) == "## z key\nv\n\n## a\n- p\n- q\n\n## m\n[not a list"


def test_best_name_and_double_keyword(spark):
    scores = {"a": text.keyword_score(F.col("t"), ("x",)), "b": text.keyword_score(F.col("t"), ("y", "y"))}
    assert one(spark, text.best_name(scores, "none"), t="xy") == "b"
    assert one(spark, text.best_name(scores, "none"), t="x") == "a"
    assert one(spark, text.best_name(scores, "none"), t="q") == "none"


@pytest.mark.parametrize(("answer", "want"), [(1, "a"), (2, "b"), (0, None), (3, None), (-1, None)])
def test_choice_at(spark, answer, want):
    assert one(spark, text.choice_at(F.array(F.lit("a"), F.lit("b")), F.col("n")), n=answer) == want


# ---------------------------------------------------------------- literals

def test_flattened_reads_json_and_python(spark):
    rows = [
        ("j", "p", '{"question": "q", "choices": ["a", "b"], "answer": 2}', "outer"),
        ("y", "p", "{'question': \"it's\", 'choices': ['a', \"b\"], 'answer': None}", None),
        ("s", "p", "{'question': 'q\\xa0r', 'choices': ('a', 'b'), 'answer': '3', 'question_plus': 'inner'}", "outer"),
        ("t", "p", "{'question': 'None or True', 'choices': [], 'answer': ''}", None),
        ("x", "p", "nothing", None),
        ("n", "p", None, None),
    ]
    df = spark.createDataFrame(rows, schemas.EXAM_RAW)
    got = {r["id"]: r for r in literals.flattened(df).collect()}
    assert (got["j"].question, got["j"].choices, got["j"].answer, got["j"].question_plus) == ("q", ["a", "b"], 2, "outer")
    assert (got["y"].question, got["y"].answer) == ("it's", None)
    assert (got["s"].question, got["s"].choices, got["s"].answer, got["s"].question_plus) == ("q r", ["a", "b"], 3, "inner")
    assert (got["t"].question, got["t"].answer) == ("None or True", None)
    assert (got["x"].question, got["x"].choices) == ("", [])
    assert {r["id"] for r in literals.flattened(df, "skip").collect()} == {"j", "y", "s", "t"}
    assert {r["id"]: r["question"] for r in literals.flattened(df, "raw").collect()}["x"] == "nothing"
    with pytest.raises(Exception, match="cannot parse problems of"):
        literals.flattened(df, "raise").collect()


# ---------------------------------------------------------------- prompts

def exam(spark, **changes):
    row = {"id": "1", "paragraph": "p {question} <USER>z</USER>", "question": "q", "choices": ["a", "b"], "answer": 2, "question_plus": None, "documents": None} | changes
    return spark.createDataFrame([tuple(row[f.name] for f in schemas.EXAM_FLAT.fields)], schemas.EXAM_FLAT)


def test_messages_do_not_read_values_again(spark):
    got = prompts.chat_messages(exam(spark)).first()["messages"]
    assert [m.role for m in got] == ["system", "user", "assistant"]
    assert got[1].content.startswith("지문:\np {question} <USER>z</USER>\n\n질문:\nq") and got[2].content == "2"
    assert "1 - a\n2 - b" in got[1].content
    assert len(prompts.chat_messages(exam(spark, answer=None)).first()["messages"]) == 2
    assert len(prompts.chat_messages(exam(spark), with_answer=False).first()["messages"]) == 2
    assert "<보 기>\nplus" in prompts.chat_messages(exam(spark, question_plus="plus")).first()["messages"][1].content


def test_templates(tmp_path, spark):
    (tmp_path / "own.txt").write_text("<SYSTEM>c {context}</SYSTEM>", encoding="utf-8")
    assert prompts.chat_messages(exam(spark, documents="D"), "own", folder=str(tmp_path)).first()["messages"][0].content == "c D"
    with pytest.raises(FileNotFoundError):
        prompts.template("none")
    with pytest.raises(KeyError):
        prompts.filled("{what}", {})


def test_few_shot(spark):
    df = exam(spark).withColumns({"target": F.lit("t"), "rank": F.lit(1), "domain": F.lit("law")})
    both = df.unionByName(df.withColumns({"rank": F.lit(2), "domain": F.lit("art")}))
    got = prompts.few_shot(both, "head {domains}\n", "tail").first()["prompt"]
    assert got.startswith("head art, law\n\n[예시 1 - law]\n지문: p ") and got.endswith("정답: 2\n\ntail")


# ---------------------------------------------------------------- retrieval

DOCS = [(1, "a b c a"), (2, "a b"), (3, "a d"), (4, "e"), (5, "a b"), (6, None)]


def okapi(query, docs, k1=1.5, b=0.75, eps=0.25):
    toks = {i: (t or "").split() for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else eps * mean for w, x in raw.items()}
    score = lambda t: sum(idf.get(w, 0) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avg)) for w in query.split())
    return sorted(((round(score(t), 9) + 0.0, i) for i, t in toks.items()), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("query", ["a b", "a a a", "e", "zzz", "", "c d e"])
def test_bm25_equals_plain_okapi(spark, tmp_path, query):
    index = bm25.build(spark.createDataFrame(DOCS, "doc_id int, text string"), f"file://{tmp_path}/i")
    got = index.top_k(spark.createDataFrame([("q", query)], "qid string, text string"), 4).orderBy("rank").collect()
    want = okapi(query, DOCS)[:4]
    assert [r.doc_id for r in got] == [i for _, i in want]
    assert [r.score for r in got] == pytest.approx([s for s, _ in want])


def test_bm25_after_changes_is_a_new_build(spark, tmp_path):
    """Appends, replaced and deleted documents and merges leave what a build of the same documents gives."""
    rng, path = random.Random(1), f"file://{tmp_path}/i"
    text_ = lambda: " ".join(rng.choices("abcdefghijklmnop", k=rng.randrange(1, 12)))
    rows = lambda d: spark.createDataFrame(sorted(d.items()) or [], "doc_id int, text string")
    held = {i: text_() for i in range(40)}
    index = bm25.build(rows(held), path)
    asked = spark.createDataFrame([(k, text_()) for k in range(8)], "qid int, text string")
    for step in range(5):
        new = {100 * step + i: text_() for i in range(12)} | ({i: text_() for i in range(step, 40, 9)} if step % 2 else {})
        before = {s["folder"] for s in index.segments}
        index = bm25.open_index(spark, path).append(rows(new))
        held |= new
        # a batch has a segment of its own, or is merged with others; the rest stay as they are
        new_ones = {s["folder"] for s in index.segments} - before
        assert len(new_ones) == 1 or len(new_ones) == 2 and len(before) >= bm25.FACTOR
        gone = rng.sample(sorted(held), 5)
        index = index.delete(spark.createDataFrame([(i,) for i in [*gone, 10**6]], "doc_id int"))
        held = {i: t for i, t in held.items() if i not in gone}
    assert len(index.segments) < 6 and bm25.open_index(spark, path).version == index.version == 11
    fresh = bm25.build(rows(held))
    assert index.size == pytest.approx(fresh.size)
    same = lambda f: sorted(tuple(r) for r in f(index).collect()) == sorted(tuple(r) for r in f(fresh).collect())
    assert same(lambda x: x.documents) and same(lambda x: x.terms) and same(lambda x: x.postings)
    for prune in (False, True):
        assert same(lambda x: x.top_k(asked, 5, prune=prune))
    with pytest.raises(store.Conflict):
        bm25.Index(spark, path, 1, {}).append(rows({1: "a"}))
    assert bm25.build(rows({1: "x"}), path).size == (1, 1.0) and bm25.build(rows({}), path).top_k(asked, 3).count() == 0


def test_pruned_search_reads_less_than_half(spark, monkeypatch):
    """Short queries of two common words and a rare one: the same rows as by scoring all, with under half of the postings."""
    monkeypatch.setattr(bm25, "RANGE", 16)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 3) for k in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, weights, k=rng.randrange(20, 80)))) for i in range(4000)], "doc_id int, text string")
    asked = spark.createDataFrame([(q, " ".join([f"w{rng.randrange(5)}", f"w{rng.randrange(5, 20)}", f"w{rng.randrange(600, 1500)}"])) for q in range(40)], "qid int, text string")
    index = bm25.build(docs)
    search = index.search(asked, 10)
    total = lambda x: x.agg(F.sum("n")).first()[0]
    assert total(search.read) < 0.5 * total(search.asked) == 0.5 * index.postings.join(bm25.query_terms(asked), "term").count()
    rows = lambda prune: [tuple(r) for r in index.top_k(asked, 10, prune=prune).orderBy("qid", "rank").select("qid", "rank", "doc_id", F.round("score", 8)).collect()]
    assert rows(True) == rows(False)


def test_other_forms_are_not_read(spark, tmp_path):
    versions = store.Versions(spark, f"file://{tmp_path}/i")
    versions.commit(0, {"form": "another"})
    with pytest.raises(bm25.OtherForm):
        bm25.open_index(spark, f"file://{tmp_path}/i")


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "doc_id int, embedding array<float>")
    got = vectors.top_k(spark.createDataFrame([(9, [1.0, 0.0])], "qid int, embedding array<float>"), rows, 2).collect()
    assert sorted((r.rank, r.doc_id, r.distance) for r in got) == [(1, 2, 0.0), (2, 3, 0.0)]


def test_vector_index_is_built_once(spark, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.createDataFrame([(1, [0.0])], "doc_id int, embedding array<float>")
    for rebuild in (False, False, True):
        assert vectors.stored_index(spark, f"file://{tmp_path}/v", build, rebuild).count() == 1
    assert len(calls) == 2


def test_fuse(spark):
    b = spark.createDataFrame([("q", 1, 10, 4.0), ("q", 2, 11, 2.0)], "qid string, rank int, doc_id int, score double")
    v = spark.createDataFrame([("q", 1, 11, 1.0), ("q", 2, 12, 3.0)], "qid string, rank int, doc_id int, distance double")
    got = [(r.doc_id, r.combined_score) for r in hybrid.fuse(b, v, top_k=0).orderBy("rank").collect()]
    assert got == [(10, 0.7), (11, 0.3), (12, 0.0)]
    equal = spark.createDataFrame([("q", 1, 10, 2.0), ("q", 2, 11, 2.0)], "qid string, rank int, doc_id int, distance double")
    assert {r[0] for r in equal.select(hybrid.normalized(F.col("distance"), "qid")).collect()} == {1.0}
    assert {r[0] for r in equal.select(hybrid.normalized(F.col("distance"), "qid", False)).collect()} == {0.0}


def test_gold_context_keeps_list_order(spark):
    records = spark.createDataFrame([("1", "p"), ("2", None), ("3", "r")], "id string, paragraph string")
    labels = spark.createDataFrame([("1", ["b", "x", "a"]), ("2", None)], "id string, gold_doc_ids array<string>")
    docs = spark.createDataFrame([("a", "A", "one"), ("b", "B", "two")], "doc_id string, title string, body string")
    got = {r.id: r.paragraph for r in context.gold_context(records, labels, docs).collect()}
    assert got == {"1": "p\n\n[CONTEXT]\n[b] B\ntwo\n\n[a] A\none", "2": None, "3": "r"}


@pytest.mark.parametrize(("top1", "top2", "want"), [("3", None, True), ("1", "0", True), ("-1", "-2", False), ("3", "2", True), ("2.9", "2", False)])
def test_confident(spark, top1, top2, want):
    assert one(spark, labeling.confident(F.col("a").cast("double"), F.col("b").cast("double")), a=top1, b=top2) is want


# ---------------------------------------------------------------- answers, metrics

def test_hard_vote(spark):
    cases = {"majority": [1, 1, 2, 3, 1], "single": [3, 1, 1, 2, 2], "missing": [None, 2, 2, 1, 1], "none": [None] * 5, "few": [None, 4, None, None, None]}
    rows = [(i, f"m{k}", a) for i, v in cases.items() for k, a in enumerate(v, 1)]
    votes = spark.createDataFrame(rows, "id string, model string, answer int")
    got = {r.id: r.answer for r in answers.hard_vote(votes, "m1").collect()}
    assert got == {"majority": 1, "single": 3, "missing": None, "none": None, "few": 4}
    agree = {r.model: r.agree for r in answers.agreement(votes, answers.hard_vote(votes, "m1")).collect()}
    assert agree == {"m1": 2, "m2": 2, "m3": 0, "m4": 0, "m5": 1}


def test_route(spark):
    t = lambda rows, c: spark.createDataFrame(rows, f"id string, {c}")
    labels = t([("1", "A"), ("2", " a\n"), ("3", "B"), ("4", None), ("5", "A")], "label string")
    p = [t([(str(i), v) for i in range(1, 5)], "answer int") for v in (1, 1, 3)]
    p[1] = t([("1", 1), ("2", 2), ("3", 1), ("4", 1)], "answer int")
    assert {r.id: r.answer for r in answers.route(labels, *p).collect()} == {"1": 1, "2": 3, "3": 3, "4": 3}


def test_macro_f1_counts_classes_on_either_side(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, None), (None, 4)], "answer int, predict int")
    want = (2 * 1 / 3 + 2 * 1 / 3 + 0) / 3
    assert metrics.macro_f1(rows).first()[0] == pytest.approx(want)
    assert metrics.accuracy(rows).first()[0] == pytest.approx(0.5)
    assert metrics.wrong(rows).count() == 3


def test_ranges_and_histogram(spark):
    rows = spark.createDataFrame([(0,), (1,), (100,), (101,)], "x int")
    got = {r.bin: (r.n, r.percent) for r in metrics.range_counts(rows, F.col("x"), [0, 100, 200]).collect()}
    assert got == {"(0, 100]": (2, 50.0), "(100, 200]": (1, 25.0), "(200, inf]": (0, 0.0)}
    same = spark.createDataFrame([(5,), (5,)], "x int")
    assert [(r.bin, r.n) for r in metrics.histogram(same, F.col("x"), 3).collect()] == [(0, 2)]
    assert sorted((r.bin, r.n) for r in metrics.histogram(rows, F.col("x"), 2).collect()) == [(0, 2), (1, 2)]


# ---------------------------------------------------------------- corpus, sampling

def test_dedup_orders(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 1, "only")], "k string, pos int, v string")
    assert {r.k: r.v for r in corpus.first_wins(rows, ["k"], ["pos"]).collect()} == {"a": "early", "b": "only"}
    assert {r.k: r.v for r in corpus.last_wins(rows, ["k"], ["pos"]).collect()} == {"a": "late", "b": "only"}
    old = spark.createDataFrame([("b", "old")], "k string, v string")
    assert sorted(map(tuple, corpus.append_unseen(old, rows, "k", "pos").collect())) == [("a", "early"), ("b", "old")]


@pytest.mark.parametrize("n", [0, 1, 5, 40, 25_000])
def test_split_is_exact(spark, n):
    got = sampling.train_test_split(spark.range(n), "id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got}.get("train", 0) == int(0.8 * n)
    assert sum(r["count"] for r in got) == n


def test_shuffle_keeps_the_right_choice(spark):
    rows = [(str(i), [f"c{k}" for k in range(5)], i % 7 if i % 7 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, choices array<string>, answer int")
    for before, after in zip(rows, sorted(sampling.shuffled_choices(df).collect(), key=lambda r: int(r.id)), strict=True):
        assert sorted(after.choices) == before[1]
        if before[2] and before[2] <= 5:
            assert after.choices[after.answer - 1] == before[1][before[2] - 1]
        else:
            assert after.answer == before[2]


def test_quota_remainder_goes_to_the_largest(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "domain string, n int")
    assert {r.domain: r.quota for r in sampling.quotas(counts, 10).collect()} == {"a": 4, "b": 3, "c": 3}


def test_two_stage_gate(spark):
    rows = spark.createDataFrame([(1, "xy"), (2, "x"), (3, "y")], "id int, prompt string")
    test = lambda c: lambda p: F.when(p.contains(c), "A").otherwise("B")
    assert {r.id: r.label for r in models.two_stage(rows, test("x"), test("y")).collect()} == {1: "A", 2: "B", 3: "B"}


def test_batched_model(spark):
    load = models.batched(lambda: lambda s: s.str.len(), "int")
    assert spark.createDataFrame([("abc",)], "t string").select(load("t")).first()[0] == 3


# ---------------------------------------------------------------- exam text

def test_questions_merge_numbers_that_go_back(spark):
    texts = spark.createDataFrame([("d", "1. a\n2. b\n1. c\n2. d\n3. e"), ("e", None), ("f", "no numbers")], "doc string, text string")
    got = sorted((r.doc, r.q_num, r.q_text) for r in exam_text.questions(texts).collect())
    assert got == [("d", 1, "1. a"), ("d", 2, "2. b\n1. c\n2. d"), ("d", 3, "3. e")]


def test_question_parts(spark):
    block = "2. 밑줄 친　것은?\n<보 기>\n보기 (cid:7)글\n① 하나 ② 둘\n ③ 셋"
    got = exam_text.with_parts(spark.createDataFrame([(block,)], "q_text string")).first()
    assert (got.question, got.choices, got.question_plus) == ("밑줄 친 것은?", ["① 하나", "② 둘", "③ 셋"], "보기 글")
    none = exam_text.with_parts(spark.createDataFrame([("3. only a question",)], "q_text string")).first()
    assert (none.question, none.choices, none.question_plus) == ("only a question", [], "")


# ---------------------------------------------------------------- files

def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b"\nc', "{}", None), ("2", "가", "x,y", "p")], schemas.EXAM_RAW)
    path = str(tmp_path / "a.csv")
    files.export_csv(df, path, bom=True)
    assert open(path, "rb").read(3) == b"\xef\xbb\xbf"
    assert sorted(map(tuple, files.read_csv(spark, path).collect())) == sorted(map(tuple, df.collect()))
    files.write_csv(df, str(tmp_path / "b"))
    assert files.read_csv(spark, str(tmp_path / "b")).count() == 2


def test_corpus_file(spark, tmp_path):
    rows = [{"doc_id": "a", "title": "T", "content": {"b": ["x"], "a": "y"}, "search_text": ""}, {"doc_id": "a", "title": "U"}]
    (tmp_path / "c.json").write_text(json.dumps(rows), encoding="utf-8")
    got = files.read_corpus(spark, str(tmp_path / "c.json"))
    assert files.corpus_by_id(got).first()["title"] == "U"
    assert corpus.searchable(got).filter("title = 'T'").first()["body"] == "## b\n- x\n\n## a\ny"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_corpus(spark, str(tmp_path / "none.json"))


def test_labels_and_checkpoints(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": "1", "gold_doc_ids": null}\n\n{"id": "2", "gold_doc_ids": ["a"]}\n')
    assert {r.id: r.gold_doc_ids for r in files.read_labels(spark, str(tmp_path / "l.jsonl")).collect()} == {"1": [], "2": ["a"]}
    paths = spark.createDataFrame([("o/checkpoint-9",), ("o/checkpoint-10",), ("o/x",)], "path string")
    assert files.latest_checkpoint(paths).first()["path"] == "o/checkpoint-10"


def test_stream_append(spark, tmp_path):
    from paperloom.streaming.append import append_stream

    kind = "doc_id string, pos int, v string"
    for k, rows in enumerate([[("a", 1, "x"), ("a", 2, "y")], [("a", 3, "z"), ("b", 1, "w")]]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        append_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == k + 1


# ---------------------------------------------------------------- plans

def test_hot_paths_stay_in_the_jvm(spark):
    from paperloom.plans import queries as q

    d = "/root/testdata/sf0.001"
    for name in ("bm25_topk", "hard_vote", "macro_f1", "choice_shuffle", "domain_detect"):
        plan = q.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan, name


# ---------------------------------------------------------------- fixed texts

def test_domains_and_gates(spark):
    row = spark.createDataFrame([("고려와 조선", "금리?", None, ["a"])], "p string, q string, x string, c array<string>")
    first, second = prompts.gate_prompts(F.col("p"), F.col("q"), F.col("c"))
    got = row.select(text.detect_domain(F.col("p"), F.col("q"), F.col("x")), first, second).first()
    assert got[0] == "한국사" and "1. a" in got[1] and "고려와 조선" in got[2]
    assert exam_text.image_sheet(spark, "한국사", 2025).filter("q_num = 20").first()["answer"] == "1"


# ---------------------------------------------------------------- life of an exam table

def raw_exams(spark, n=10):
    rows = [(f"{i:02}", f"passage {i}", json.dumps({"question": "q", "choices": ["a", "b"], "answer": i % 2 + 1}), None) for i in range(n)]
    return spark.createDataFrame(rows, schemas.EXAM_RAW)


def test_inference_and_evaluation(spark):
    from paperloom.plans import exam

    corpus_rows = [("d1", None, "T", [], None, '{"k": "v"}', "passage 3"), ("d2", None, None, [], None, None, "other")]
    docs = spark.createDataFrame(corpus_rows, schemas.CORPUS)
    first = lambda m: F.array(F.lit(0.5), F.lit(0.5))
    by_document = lambda m: F.when(m[1]["content"].contains("#### 1. T"), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    gates = (lambda p: F.when(p.contains("passage 3"), "A").otherwise("B"), lambda p: F.lit("A"))
    assert {r.answer for r in exam.inference(raw_exams(spark), first, exam.Settings()).collect()} == {1}
    got = {r.id: r.answer for r in exam.inference(raw_exams(spark), by_document, exam.Settings(retrieve=True), docs, gates).collect()}
    assert [i for i, a in got.items() if a == 2] == ["03"] and len(got) == 10
    rows, scores = exam.evaluation(raw_exams(spark), first, exam.Settings())
    assert rows.count() == 2 and 0 <= scores.first()["accuracy"] <= 1


def test_generated_tries_again(spark):
    def client():
        seen = []

        def call(text):
            seen.append(text)
            if text == "bad" or (text == "late" and seen.count("late") < 2):
                raise RuntimeError("no")
            return text.upper()

        return call

    rows = spark.createDataFrame([("ok",), ("late",), ("bad",)], "prompt string").coalesce(1)
    assert {r.prompt: (r.output, r.error) for r in models.generated(rows, client, wait=0).collect()} == {"ok": ("OK", None), "late": ("LATE", None), "bad": (None, "no")}


def test_registry():
    from paperloom.registry import Registry

    parts = Registry("part")
    parts.register("a")(1)
    assert parts.get("a") == 1 and parts.names() == ["a"]
    for bad in (lambda: parts.get("b"), lambda: parts.register("a")(2)):
        with pytest.raises(KeyError):
            bad()


def test_vectors_equal_brute_force(spark):
    """Ties, null and short vectors, several blocks of queries, parts of batches, and more wanted than there are."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(300)] + [(900, None), (901, [1.0])]
    asked = [(q, [float(x) for x in rng.normal(size=3)]) for q in range(20)] + [(99, None)]
    kind = "{} long, embedding array<float>"
    docs, queries = spark.createDataFrame(rows, kind.format("doc_id")).repartition(3), spark.createDataFrame(asked, kind.format("qid"))
    real = {r.qid: r.embedding for r in queries.collect() if r.embedding}
    for k, block, cells in ((7, 4096, 4_000_000), (7, 6, 100), (500, 4096, 1000)):
        vectors.BLOCK, vectors.CELLS, before = block, cells, (vectors.BLOCK, vectors.CELLS)
        try:
            got = {}
            for r in vectors.top_k(queries, docs, k).collect():
                got.setdefault(r.qid, []).append((r["rank"], r.doc_id, r.distance))
        finally:
            vectors.BLOCK, vectors.CELLS = before
        for q, v in real.items():
            every = sorted((round(sum((a - b) ** 2 for a, b in zip(v, x)), 9), i) for i, x in rows[:300])[:k]
            assert [(n, i) for n, i, _ in sorted(got[q])] == [(n, i) for n, (_, i) in enumerate(every, 1)]
        assert set(got) == set(real)
    assert vectors.top_k(queries, docs.limit(0)).count() == 0 and vectors.top_k(queries.limit(0), docs).count() == 0


def test_split_goes_down_by_prefixes(spark, monkeypatch):
    want = {r.id: r.split for r in sampling.train_test_split(spark.range(9000), "id").collect()}
    monkeypatch.setattr(sampling, "GROUP", 2)
    assert {r.id: r.split for r in sampling.train_test_split(spark.range(9000), "id").collect()} == want


def test_modes(spark):
    from paperloom.plans import exam

    first = lambda m: F.array(F.lit(0.5), F.lit(0.5))
    raw = raw_exams(spark)
    train = exam.run("train", raw, exam.Settings()).collect()
    assert len(train) == 8 and all(r.messages[-1]["role"] == "assistant" and r.messages[-1]["content"] == str(r.answer) for r in train)
    assert [r.id for r in exam.run("inference", raw, exam.Settings(), first).collect()] == [f"{i:02}" for i in range(10)]
    assert exam.run("evaluate", raw, exam.Settings(), first).columns == ["accuracy", "macro_f1"]
    for bad in (lambda: exam.run("other", raw, exam.Settings()), lambda: exam.run("evaluate", raw, exam.Settings())):
        with pytest.raises(ValueError):
            bad()


def test_logger():
    from paperloom.log import get_logger

    assert get_logger("t1") is get_logger("t1") and len(get_logger("t1").handlers) == 1 and not get_logger("t1").propagate


def corpus_rows(spark, *ids):
    return spark.createDataFrame([(i, None, f"제목 {i}", [], None, '{"k": "v"}', "x") for i in ids], schemas.CORPUS)


def test_corpus_versions(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    assert files.corpus_or_empty(spark, path).count() == 0
    assert files.write_corpus(corpus_rows(spark, "é1", "2"), path) == 1
    assert any("제목" in p.read_text(encoding="utf-8") for p in (tmp_path / "c").glob("corpus-*/part-*"))
    before = files.read_corpus(spark, path)
    assert files.write_corpus(files.read_corpus(spark, path).filter("doc_id != '2'"), path) == 2
    assert [r.title for r in files.read_corpus(spark, path).collect()] == ["제목 é1"]
    assert before.count() == 2  # a reader of the version before keeps its files
    assert files.write_corpus(corpus_rows(spark, "2").limit(0), path) == 3
    assert files.read_corpus(spark, path).count() == 0 and len(list((tmp_path / "c").glob("corpus-*"))) == 2
    for p in (tmp_path / "c").glob("corpus-*/part-*"):
        p.write_text("[{broken", encoding="utf-8")
    for p in (tmp_path / "c").glob("corpus-*/.*crc"):
        p.unlink()
    assert files.corpus_or_empty(spark, path).count() == 0


@pytest.mark.parametrize("step", ["files", "half a record", "record"])
def test_a_writer_that_stops_loses_nothing(spark, tmp_path, monkeypatch, step):
    """A crash before the record, within it, and after it: the old version counts, or else the new one does; the next write goes on."""
    path = f"file://{tmp_path}/c"
    files.write_corpus(corpus_rows(spark, *map(str, range(100))), path)

    class Crash(RuntimeError):
        pass

    whole = store.Versions._write

    def stop(self, number, line):
        if step == "half a record":
            whole(self, number, line[: len(line) // 2])
        elif step == "record":
            whole(self, number, line)
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(store.Versions, "_write", stop)
        with pytest.raises(Crash):
            files.write_corpus(files.read_corpus(spark, path).filter("doc_id != '7'"), path)
    assert files.read_corpus(spark, path).count() == (99 if step == "record" else 100)
    files.write_corpus(files.corpus_or_empty(spark, path).unionByName(corpus_rows(spark, "new")), path)
    assert files.read_corpus(spark, path).count() == (100 if step == "record" else 101)


def test_of_two_writers_the_later_fails(spark, tmp_path):
    one, two = (store.Versions(spark, f"file://{tmp_path}/v") for _ in range(2))
    assert one.commit(0, {"folders": []}) == 1
    with pytest.raises(store.Conflict):
        two.commit(0, {"folders": []})
    with pytest.raises(store.Conflict):
        two._write(1, "{}\n")
    assert two.latest() == (1, {"folders": []})


def test_last_in_file_order(spark, tmp_path):
    """Parts of unlike size, which Spark deals by size, and several records of one id in a file."""
    record = lambda i, t: json.dumps({"doc_id": i, "title": t})
    (tmp_path / "part-00009-x.json").write_text(f"[{record('a', 'first')}]")
    (tmp_path / "part-00010-x.json").write_text("[" + ",\n".join([record("a", "mid"), record("a", "last"), *(record(str(k), "x" * 200) for k in range(300))]) + "]")
    (tmp_path / "part-00002-x.json").write_text("[" + ",\n".join([record("a", "earliest"), *(record(f"b{k}", "x" * 200) for k in range(900))]) + "]")
    kept = files.corpus_by_id(files.read_corpus(spark, str(tmp_path)))
    assert kept.count() == 1201 and kept.filter("doc_id = 'a'").first()["title"] == "last"


def test_retrievers(spark):
    from paperloom.operators import retrieval
    from paperloom.registry import RETRIEVERS

    assert RETRIEVERS.names() == ["bm25", "hybrid", "vector"]
    docs = spark.createDataFrame([(1, "A", "apple pie", "apple pie", "x"), (2, None, "pear tart", "pear tart", "y"), (3, "C", "plum jam", "plum jam", "z")], "doc_id long, title string, text string, body string, shelf string")
    embed = lambda rows: models.embedded(rows, "text", lambda: lambda t: t.map(lambda x: [float("pear" in x), 1.0])).select("key", "embedding")
    asked = spark.createDataFrame([(7, "pear")], "qid long, text string")
    lexical = RETRIEVERS.get("bm25")(docs)
    both = RETRIEVERS.get("hybrid")(lexical, RETRIEVERS.get("vector")(docs, embed))
    for retriever in (lexical, both):
        top = retriever.retrieve(asked, 1).first()
        assert (top.doc_id, top.title, top.content, top.metadata["shelf"]) == (2, "", "pear tart", "y")
    assert both.retrieve(asked, 0).count() == 3
    with pytest.raises(TypeError):
        lexical.retrieve("pear")
    assert "pear tart" in retrieval.RagPipeline(lexical, 1).run("pear")


def test_index_is_built_anew_when_the_table_changes(spark, tmp_path):
    from paperloom.plans import queries

    queries.forget_indexes()
    sizes = []
    for text_ in ("one", "one two"):
        spark.createDataFrame([(1, text_)], "doc_id long, text string").write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
        sizes += [queries.bm25_index(spark, f"file://{tmp_path}").size, queries.bm25_index(spark, f"file://{tmp_path}").size]
    assert sizes == [(1, 1.0), (1, 1.0), (1, 2.0), (1, 2.0)] and len(queries._INDEXES) == 1
    queries.forget_indexes()
