"""Queries over the driver's tables, each with the SQL that gives the same rows.

Stand-ins: the corpus is ``documents``, exam items are ``benchmark``, dense vectors are ``embeddings``. Model
predictions, choices and domains have no table; they are derived from ids by integer arithmetic, alike in
both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import fixed, literals, prompts, text
from paperloom.operators import answers, bm25, context, corpus, exam_text, hybrid, labeling, metrics, models, sampling, vectors
from paperloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODELS = ("m1", "m2", "m3", "m4", "m5")
#: Stand-in domains and their keywords, in declared order.
DOMAINS = {"law": ("the", "that", "this"), "art": ("des", "les", "une"), "trade": ("der", "die", "und"), "mind": ("los", "las", "que")}
GENERAL = "general"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


# ------------------------------------------------------------------ retrieval

BM25_CTES = """
tok AS (SELECT doc_id, regexp_extract_all(text, '[가-힣]+|[A-Za-z0-9]+') AS toks FROM documents),
dl AS (SELECT doc_id, len(toks) AS dl FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf0 FROM post, st GROUP BY term, n),
av AS (SELECT avg(idf0) AS avg_idf FROM raw),
idf AS (SELECT term, df, CASE WHEN idf0 < 0 THEN 0.25 * avg_idf ELSE idf0 END AS idf FROM raw, av),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(text, '[가-힣]+|[A-Za-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT qid, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
       FROM q JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id), st GROUP BY qid, doc_id),
fil AS (SELECT item_id AS qid, doc_id, 0.0::DOUBLE AS score FROM benchmark, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20) d WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.qid = item_id AND sc.doc_id = d.doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (FROM sc UNION ALL FROM fil)),
bm AS (SELECT qid, rank, doc_id, score FROM rk WHERE rank <= 10)
"""
VEC_CTES = """
vq AS (SELECT item_id AS qid, embedding FROM benchmark JOIN embeddings ON vec_id = item_id),
vd AS (SELECT qid, vec_id AS doc_id, round(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) FOR x IN list_zip(vq.embedding, e.embedding)]), 9) AS distance FROM vq, embeddings e),
ve AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id) AS rank FROM vd) WHERE rank <= 10)
"""
HY_CTES = """
b AS (SELECT qid, doc_id, rank, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS b FROM bm WINDOW w AS (PARTITION BY qid)),
v AS (SELECT qid, doc_id, rank, 1.0 - CASE WHEN max(distance) OVER w = min(distance) OVER w THEN 1.0 ELSE (distance - min(distance) OVER w) / (max(distance) OVER w - min(distance) OVER w) END AS v FROM ve WINDOW w AS (PARTITION BY qid)),
j AS (SELECT coalesce(b.qid, v.qid) AS qid, coalesce(b.doc_id, v.doc_id) AS doc_id, coalesce(b, 0) AS bs, coalesce(v, 0) AS vs, round(0.7 * coalesce(b, 0) + 0.3 * coalesce(v, 0), 9) AS c, b.rank AS r1, v.rank AS r2
      FROM b FULL JOIN v ON b.qid = v.qid AND b.doc_id = v.doc_id),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, r1 ASC NULLS LAST, r2 ASC NULLS LAST, doc_id) AS rank FROM j) WHERE rank <= 3)
"""


_INDEXES: dict[tuple, bm25.Index] = {}


def bm25_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The index of a corpus, built by the first query of a session that needs it, and anew when the table's files change."""
    files_now = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/documents.parquet").select("path", "length", F.col("modificationTime").cast("string"))
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(tuple(r) for r in files_now.collect()))
    if key not in _INDEXES:
        for old in [k for k in _INDEXES if k[:2] == key[:2]]:
            del _INDEXES[old]
        _INDEXES[key] = bm25.build(docs(spark, sf_dir))
    return _INDEXES[key]


def forget_indexes() -> None:
    """The next query builds its index again, as a timing must."""
    _INDEXES.clear()


def bm25_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_index(spark, sf_dir).top_k(items(spark, sf_dir), hybrid.BM25_K)


def vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = items(spark, sf_dir).select("qid").join(dense.withColumnRenamed("doc_id", "qid"), "qid")
    return vectors.top_k(asked, dense, hybrid.VEC_K)


def hybrid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.fuse(bm25_hits(spark, sf_dir), vector_hits(spark, sf_dir))


@query(f"WITH {BM25_CTES} SELECT qid, rank, doc_id, round(score, 6) AS score FROM bm")
def bm25_topk(spark, sf_dir):
    """Best documents of each benchmark item."""
    return bm25_hits(spark, sf_dir).withColumn("score", r6("score"))


@query(f"WITH {BM25_CTES} SELECT qid, rank, doc_id, round(score, 6) AS score FROM bm")
def bm25_pruned(spark, sf_dir):
    """The same by bounds of blocks: ranges and terms that can't lift a document into the best are not read."""
    return bm25_index(spark, sf_dir).top_k(items(spark, sf_dir), hybrid.BM25_K, prune=True).withColumn("score", r6("score"))


@query(f"WITH {BM25_CTES} SELECT qid, rank, doc_id, round(score, 6) AS score FROM bm")
def bm25_incremental(spark, sf_dir):
    """The same from an index that grew by parts: two thirds of the documents and some others' texts first, then the rest, after a delete."""
    all_docs = docs(spark, sf_dir)
    first = all_docs.filter("doc_id % 3 != 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text")))
    extra = all_docs.filter("doc_id % 11 = 0").withColumn("doc_id", -1 - F.col("doc_id"))
    index = bm25.build(first.unionByName(extra)).delete(extra.select("doc_id"))
    index = index.append(all_docs.filter("doc_id % 3 = 0 and doc_id % 2 = 0")).append(all_docs.filter("doc_id % 3 = 0 and doc_id % 2 != 0 or doc_id % 3 != 0 and doc_id % 7 = 0"))
    return bm25.open_index(spark, index.path).top_k(items(spark, sf_dir), hybrid.BM25_K).withColumn("score", r6("score"))


@query(f"WITH {BM25_CTES} SELECT qid, count(*) AS n, round(sum(score), 4) AS total FROM sc GROUP BY qid")
def bm25_scores_all(spark, sf_dir):
    """All scores of each item, summed up."""
    scores = bm25_index(spark, sf_dir).matches(items(spark, sf_dir)).withColumn("score", F.round("score", bm25.DIGITS))
    return scores.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query(f"WITH {BM25_CTES} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, sf_dir):
    """Document frequency and weight of each term."""
    return bm25_index(spark, sf_dir).idf().select("term", "df", r6("idf").alias("idf"))


@query(f"WITH {BM25_CTES} SELECT term, sum(tf)::BIGINT AS total, max(tf)::BIGINT AS most, count(*) AS n FROM post GROUP BY term")
def bm25_postings(spark, sf_dir):
    """Each term's postings, summed up."""
    return bm25_index(spark, sf_dir).postings.groupBy("term").agg(F.sum("tf").alias("total"), F.max("tf").alias("most"), F.count("*").alias("n"))


@query(f"WITH {BM25_CTES} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM st")
def bm25_stats(spark, sf_dir):
    return bm25_index(spark, sf_dir).documents.agg(F.count("*").alias("n_docs"), r6(F.avg("dl")).alias("avgdl"))


@query(f"WITH {VEC_CTES} SELECT qid, rank, doc_id, round(distance, 6) AS distance FROM ve")
def vector_topk(spark, sf_dir):
    """Nearest vectors of each item's own."""
    return vector_hits(spark, sf_dir).withColumn("distance", r6("distance"))


@query(f"WITH {BM25_CTES}, {VEC_CTES}, {HY_CTES} SELECT qid, doc_id, round(b, 6) AS b FROM b")
def score_normalize(spark, sf_dir):
    """Min-max normalised scores of each list."""
    return bm25_hits(spark, sf_dir).select("qid", "doc_id", r6(hybrid.normalized(F.col("score"), "qid")).alias("b"))


@query(f"WITH {BM25_CTES}, {VEC_CTES}, {HY_CTES} SELECT qid, rank, doc_id, round(bs, 6) AS bm25_score, round(vs, 6) AS vec_score, round(c, 6) AS combined_score FROM hy")
def hybrid_topk(spark, sf_dir):
    return hybrid_hits(spark, sf_dir).select("qid", "rank", "doc_id", *[r6(c).alias(c) for c in ("bm25_score", "vec_score", "combined_score")])


RAG_SQL = f"""{BM25_CTES}, {VEC_CTES}, {HY_CTES},
ctx AS (SELECT qid, '{fixed.CONTEXT_PREFACE}' || string_agg('#### ' || rn || '. ' || source || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS documents
        FROM (SELECT hy.*, d.source, d.text, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rn FROM hy JOIN documents d USING (doc_id)) GROUP BY qid)"""


def rag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"))
    return context.assembled(hybrid_hits(spark, sf_dir), bodies)


@query(f"WITH {RAG_SQL} SELECT qid, md5(documents) AS documents FROM ctx")
def rag_context(spark, sf_dir):
    """The assembled context of each item, by digest."""
    return rag_documents(spark, sf_dir).select("qid", F.md5("documents").alias("documents"))


@query(f"WITH {RAG_SQL} SELECT item_id AS qid, md5(CASE WHEN documents <> '' THEN text || chr(10) || chr(10) || documents ELSE text END) AS paragraph FROM benchmark LEFT JOIN ctx ON qid = item_id")
def rag_augment(spark, sf_dir):
    """Items with their context."""
    joined = items(spark, sf_dir).join(rag_documents(spark, sf_dir), "qid", "left")
    return joined.select("qid", F.md5(context.augmented_paragraph(F.col("text"), F.col("documents"))).alias("paragraph"))


@query(f"WITH {RAG_SQL} SELECT item_id AS id, CASE WHEN item_id % 2 = 0 AND length(text) > 200 THEN md5(documents) END AS documents FROM benchmark LEFT JOIN ctx ON qid = item_id")
def rag_gate(spark, sf_dir):
    """Only items that pass both tests (derived: an even id, more than 200 characters) get a context."""
    rows = items(spark, sf_dir).withColumnRenamed("qid", "id")
    return context.gated(rows, F.col("id") % 2 == 0, F.length("text") > 200, rag_documents(spark, sf_dir)).select("id", F.md5("documents").alias("documents"))


@query("""WITH w AS (SELECT doc_id AS id, unnest([doc_id + 1, doc_id + 3, -1]) AS g, generate_subscripts([1, 2, 3], 1) AS pos FROM labels WHERE quality = 1),
c AS (SELECT id, string_agg('[' || g || '] ' || coalesce(d.source, '') || chr(10) || d.text, chr(10) || chr(10) ORDER BY pos) AS ctx FROM w JOIN documents d ON d.doc_id = g GROUP BY id)
SELECT d.doc_id AS id, md5(CASE WHEN ctx <> '' THEN d.text || chr(10) || chr(10) || '[CONTEXT]' || chr(10) || ctx ELSE d.text END) AS paragraph FROM documents d LEFT JOIN c ON c.id = d.doc_id""")
def gold_context_append(spark, sf_dir):
    """Documents with the texts of their gold ids (derived: the ids one and three above, and one that is unknown)."""
    d = table(spark, sf_dir, "documents")
    gold = F.array(F.col("doc_id") + 1, F.col("doc_id") + 3, F.lit(-1).cast("long")).cast("array<string>")
    labels = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"), gold.alias("gold_doc_ids"))
    bodies = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), F.col("text").alias("body"))
    out = context.gold_context(d.select(F.col("doc_id").alias("id"), F.col("text").alias("paragraph")), labels, bodies)
    return out.select("id", F.md5("paragraph").alias("paragraph"))


CHOICES_SQL = "[split_part(text, ' ', 1), split_part(text, ' ', 2), split_part(text, ' ', 3), split_part(text, ' ', 4)]"


def choices(df: DataFrame) -> DataFrame:
    """Derived: the text's first four words are choices, (id mod 6) the answer (0 and 5 are outside)."""
    return df.withColumn("choices", F.array(*[F.split_part(F.col("text"), F.lit(" "), F.lit(k)) for k in (1, 2, 3, 4)])).withColumn("answer", (F.col("id") % 6).cast("int"))


@query(f"""SELECT item_id AS id, regexp_replace(trim(regexp_replace(text || ' 정답: ' || coalesce(CASE WHEN item_id % 6 BETWEEN 1 AND 4 THEN {CHOICES_SQL}[item_id % 6] END, (item_id % 6)::VARCHAR), '\\s+', ' ', 'g')), '\\s+', ' ', 'g') AS query FROM benchmark""")
def oracle_query(spark, sf_dir):
    rows = choices(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id"))
    return rows.select("id", labeling.oracle_query(F.col("text"), F.lit(None).cast("string"), F.col("choices"), F.col("answer")).alias("query"))


@query(f"""WITH {BM25_CTES}, r AS (SELECT qid, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b FROM bm GROUP BY qid)
SELECT qid, CASE WHEN b IS NULL THEN true WHEN b <= 0 THEN a > 0 ELSE a / b >= 1.5 END AS confident FROM r""")
def ratio_confidence(spark, sf_dir):
    return labeling.ratios(bm25_hits(spark, sf_dir)).select("qid", labeling.confident(F.col("top1"), F.col("top2")).alias("confident"))


@query(f"""WITH {BM25_CTES}, r AS (SELECT qid, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b, max(doc_id) FILTER (rank = 1) AS top FROM bm GROUP BY qid),
s AS (SELECT qid, top, CASE WHEN b IS NULL THEN true WHEN b <= 0 THEN a > 0 ELSE a / b >= 1.5 END AND contains(lower(concat_ws(' ', d.source, d.text)), lower(split_part(q.text, ' ', 2))) AS sure
      FROM r JOIN benchmark q ON item_id = qid JOIN documents d ON d.doc_id = top)
SELECT qid, CASE WHEN sure THEN top END AS gold_doc_id, CASE WHEN sure THEN 'auto_ratio' ELSE 'uncertain' END AS method FROM s""")
def oracle_query_label(spark, sf_dir):
    """Labels of items; derived: an item's second word is its answer."""
    bodies = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"))
    known = items(spark, sf_dir).select("qid", F.split_part("text", F.lit(" "), F.lit(2)).alias("answer_text"))
    return labeling.auto_label(bm25_hits(spark, sf_dir), known, bodies)


@query("SELECT doc_id, contains(lower(concat_ws(' ', source, text)), lower(split_part(text, ' ', 3))) AS found FROM documents")
def answer_match(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", labeling.holds_answer(F.split_part("text", F.lit(" "), F.lit(3)), F.col("source"), F.col("text")).alias("found"))


# ------------------------------------------------------------------ answers

VOTES_SQL = "v AS (SELECT doc_id AS id, m, CASE WHEN (doc_id + m) % 11 <> 0 THEN (doc_id * 7 + (doc_id // (m + 1)) * 3 + m) % 5 + 1 END AS answer FROM documents, range(1, 6) t(m))"
VOTE_SQL = f"""{VOTES_SQL}, c AS (SELECT id, answer, count(*) AS n FROM v WHERE answer IS NOT NULL GROUP BY ALL),
b AS (SELECT id, CASE WHEN count(*) = 1 THEN max(answer) END AS mode FROM (SELECT *, max(n) OVER (PARTITION BY id) AS top FROM c) WHERE n = top GROUP BY id),
f AS (SELECT v.id, coalesce(mode, v.answer) AS answer FROM v LEFT JOIN b USING (id) WHERE m = 1)"""


def predicted(d: DataFrame, m: int) -> DataFrame:
    answer = (F.col("doc_id") * 7 + F.floor(F.col("doc_id") / (m + 1)) * 3 + m) % 5 + 1
    return d.select(F.col("doc_id").alias("id"), F.when((F.col("doc_id") + m) % 11 != 0, answer).alias("answer"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return answers.long_form({name: predicted(d, k) for k, name in enumerate(MODELS, 1)})


@query(f"WITH {VOTE_SQL} SELECT id, answer FROM f")
def hard_vote(spark, sf_dir):
    """Majority of five derived predictions; the first model breaks ties."""
    return answers.hard_vote(votes(spark, sf_dir), "m1")


@query(f"WITH {VOTE_SQL} SELECT 'm' || m AS model, count(*) FILTER (v.answer = f.answer) AS agree, round(100.0 * count(*) FILTER (v.answer = f.answer) / count(*), 6) AS percent FROM v JOIN f USING (id) GROUP BY m")
def vote_agreement(spark, sf_dir):
    v = votes(spark, sf_dir)
    return answers.agreement(v, answers.hard_vote(v, "m1")).withColumn("percent", r6("percent"))


@query(f"""WITH {VOTES_SQL} SELECT l.doc_id AS id, CASE WHEN quality = 1 AND a.answer = b.answer THEN a.answer ELSE c.answer END AS answer
FROM labels l JOIN v a ON a.id = l.doc_id AND a.m = 1 JOIN v b ON b.id = l.doc_id AND b.m = 2 JOIN v c ON c.id = l.doc_id AND c.m = 3""")
def route_ensemble(spark, sf_dir):
    """Label A (quality 1, written ' a ') takes agreeing models, else the third."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, " a ").otherwise("B").alias("label"))
    return answers.route(labels, *[predicted(d, k) for k in (1, 2, 3)])


JUDGED_SQL = "j AS (SELECT doc_id, quality + 1 AS answer, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 3 ELSE doc_id % 2 + 1 END AS predict FROM labels)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 5 == 0, 3).otherwise(F.col("doc_id") % 2 + 1)
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1).cast("long").alias("answer"), guess.cast("long").alias("predict"))


@query(f"WITH {JUDGED_SQL} SELECT round(avg(coalesce(answer = predict, false)::INT), 6) AS accuracy FROM j")
def accuracy(spark, sf_dir):
    return metrics.accuracy(judged(spark, sf_dir)).select(r6("accuracy").alias("accuracy"))


@query(f"""WITH {JUDGED_SQL}, l AS (SELECT answer AS k FROM j UNION SELECT predict FROM j WHERE predict IS NOT NULL),
f AS (SELECT k, 2.0::DOUBLE * count(*) FILTER (answer = k AND predict = k) / nullif(count(*) FILTER (answer = k) + count(*) FILTER (predict = k), 0) AS f FROM l, j GROUP BY k)
SELECT round(avg(coalesce(f, 0)), 6) AS macro_f1 FROM f""")
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(judged(spark, sf_dir)).select(r6("macro_f1").alias("macro_f1"))


@query(f"WITH {JUDGED_SQL} SELECT answer::BIGINT AS truth, predict::BIGINT AS guess, count(*) AS n FROM j GROUP BY ALL")
def confusion(spark, sf_dir):
    return metrics.confusion(judged(spark, sf_dir))


@query(f"WITH {JUDGED_SQL} SELECT doc_id FROM j WHERE NOT coalesce(answer = predict, false)")
def wrong_answers(spark, sf_dir):
    return metrics.wrong(judged(spark, sf_dir)).select("doc_id")


@query(f"WITH {JUDGED_SQL} SELECT CASE WHEN answer = predict THEN 'O' ELSE 'X' END AS correct, count(*) AS n FROM j GROUP BY ALL")
def case_result(spark, sf_dir):
    return metrics.marked(judged(spark, sf_dir)).groupBy("correct").agg(F.count("*").alias("n"))


@query("""SELECT vec_id AS id, list_position(embedding[1:5], list_max(embedding[1:5]))::INT AS answer FROM embeddings""")
def predict_argmax(spark, sf_dir):
    """Derived: a vector's first five values are the scores of five choices."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 5).alias("scores"))
    return models.predictions(rows, F.col("scores"))


@query("SELECT vec_id AS id, CASE WHEN embedding[1] > embedding[2] THEN 'A' ELSE 'B' END AS label FROM embeddings")
def classify_ab(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), models.ab_label(F.col("embedding")[0], F.col("embedding")[1]).alias("label"))


# ------------------------------------------------------------------ corpus, profiles

@query("""WITH n AS (SELECT doc_id // 2 AS k, doc_id, source FROM documents WHERE doc_id % 3 <> 0), e AS (SELECT doc_id AS k, source FROM documents WHERE doc_id % 5 = 0)
SELECT k, source FROM e UNION ALL (SELECT DISTINCT ON (k) k, source FROM n ANTI JOIN e USING (k) ORDER BY k, doc_id)""")
def corpus_append_dedup(spark, sf_dir):
    """Derived: new rows have key doc_id div 2 in order of doc_id, every fifth id is there already."""
    d = table(spark, sf_dir, "documents")
    old = d.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("k"), "source")
    new = d.filter("doc_id % 3 != 0").select(F.expr("doc_id div 2").alias("k"), F.col("doc_id").alias("pos"), "source")
    return corpus.append_unseen(old, new, "k", "pos")


@query("SELECT DISTINCT ON (source) source, doc_id FROM documents ORDER BY source, doc_id DESC")
def last_wins_dedup(spark, sf_dir):
    return corpus.last_wins(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])


@query("SELECT event_id AS id, (props ->> 'k')::INT AS answer FROM events")
def flatten_problems(spark, sf_dir):
    """Nested values from JSON text; derived: props are the problems, key k the answer."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("").alias("paragraph"), F.replace("props", F.lit('"k"'), F.lit('"answer"')).alias("problems"))
    return literals.flattened(rows).select("id", "answer")


@query("SELECT lang AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def value_counts(spark, sf_dir):
    return metrics.value_counts(table(spark, sf_dir, "documents"), "lang").withColumn("share", r6("share"))


@query("SELECT round(avg(length(text)), 6) AS mean, median(length(text)) AS median, min(length(text)) AS min, max(length(text)) AS max, round(stddev_samp(length(text)), 4) AS std FROM documents")
def length_stats(spark, sf_dir):
    out = metrics.length_stats(docs(spark, sf_dir), F.length("text"))
    return out.select(r6("mean").alias("mean"), "median", "min", "max", F.round("std", 4).alias("std"))


@query("""WITH x AS (SELECT length(text)::DOUBLE AS x FROM documents), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
SELECT least(floor(coalesce((x - lo) / nullif(hi - lo, 0), 0) * 30), 29)::BIGINT AS bin, count(*) AS n FROM x, e GROUP BY 1""")
def histogram30(spark, sf_dir):
    return metrics.histogram(docs(spark, sf_dir), F.length("text"), 30)


@query("""WITH b(k, lo, hi, bin) AS (VALUES (0, 0, 100, '(0, 100]'), (1, 100, 500, '(100, 500]'), (2, 500, 1000, '(500, 1000]'), (3, 1000, 5000, '(1000, 5000]'), (4, 5000, NULL, '(5000, inf]')),
c AS (SELECT k, count(*) AS n FROM documents JOIN b ON length(text) > lo AND (hi IS NULL OR length(text) <= hi) GROUP BY k)
SELECT bin, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM documents), 6) AS percent FROM b LEFT JOIN c USING (k)""")
def length_bins(spark, sf_dir):
    return metrics.range_counts(docs(spark, sf_dir), F.length("text"), [0, 100, 500, 1000, 5000]).withColumn("percent", r6("percent"))


@query("SELECT round(avg((length(text) < 100)::INT) * 100, 6) AS percent FROM documents")
def short_ratio(spark, sf_dir):
    return metrics.share_below(docs(spark, sf_dir), F.length("text"), 100).select(r6("percent").alias("percent"))


@query("""SELECT 'doc_id' AS "column", count(*) AS n_rows, count(*) - count(doc_id) AS n_nulls FROM documents UNION ALL SELECT 'text', count(*), count(*) - count(text) FROM documents
UNION ALL SELECT 'lang', count(*), count(*) - count(lang) FROM documents UNION ALL SELECT 'source', count(*), count(*) - count(source) FROM documents UNION ALL SELECT 'n_chars', count(*), count(*) - count(n_chars) FROM documents""")
def profile_nulls(spark, sf_dir):
    return metrics.profile(table(spark, sf_dir, "documents")).select("column", "n_rows", "n_nulls")


@query("SELECT doc_id FROM documents WHERE length(text) < 100")
def short_texts(spark, sf_dir):
    return docs(spark, sf_dir).filter(F.length("text") < 100).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'License') AND NOT contains(text, 'MIT')")
def contains_filter(spark, sf_dir):
    return docs(spark, sf_dir).filter(F.col("text").contains("License") & ~F.col("text").contains("MIT")).select("doc_id")


def domain_sql() -> str:
    score = {d: " + ".join(f"contains(lower(text), '{w}')::INT" for w in words) for d, words in DOMAINS.items()}
    top = "greatest(" + ", ".join(score.values()) + ")"
    return f"dom AS (SELECT doc_id, CASE WHEN {top} = 0 THEN '{GENERAL}' " + " ".join(f"WHEN {s} = {top} THEN '{d}'" for d, s in score.items()) + " END AS domain FROM documents)"


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = docs(spark, sf_dir).select("doc_id", F.lower("text").alias("low"))
    scored = lowered.select("doc_id", *[text.keyword_score(F.col("low"), w).alias(d) for d, w in DOMAINS.items()])
    return scored.select("doc_id", text.best_name({d: F.col(d) for d in DOMAINS}, GENERAL).alias("domain"))


@query(f"WITH {domain_sql()} SELECT doc_id, domain FROM dom")
def domain_detect(spark, sf_dir):
    """The domain with the most keywords; derived keyword lists."""
    return domains(spark, sf_dir)


@query(f"WITH {domain_sql()} SELECT domain, count(*) AS n FROM dom GROUP BY domain")
def domain_counts(spark, sf_dir):
    return domains(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"))


@query(f"""WITH {domain_sql()}, c AS (SELECT domain, count(*) AS n FROM dom GROUP BY domain), q AS (SELECT *, (777 * n) // (sum(n) OVER ()) AS quota FROM c)
SELECT domain, n, (quota + CASE WHEN row_number() OVER (ORDER BY n DESC, domain) = 1 THEN 777 - sum(quota) OVER () ELSE 0 END)::BIGINT AS quota FROM q""")
def domain_quota(spark, sf_dir):
    return sampling.quotas(domain_counts(spark, sf_dir), 777)


@query(f"""WITH {domain_sql()}, c AS (SELECT domain, count(*) AS n FROM dom GROUP BY domain), q AS (SELECT *, (50 * n) // (sum(n) OVER ()) AS quota FROM c),
f AS (SELECT domain, quota + CASE WHEN row_number() OVER (ORDER BY n DESC, domain) = 1 THEN 50 - sum(quota) OVER () ELSE 0 END AS quota FROM q)
SELECT domain, unnest(range(1, quota::BIGINT + 1))::INT AS k FROM f""")
def domain_schedule(spark, sf_dir):
    return sampling.schedule(sampling.quotas(domain_counts(spark, sf_dir), 50))


# ------------------------------------------------------------------ sampling

@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM documents")
def train_test_split(spark, sf_dir):
    return sampling.train_test_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 10")
def seeded_sample(spark, sf_dir):
    return sampling.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 10)


@query("SELECT doc_id, lang, rank::INT AS rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 3")
def stratified_pick(spark, sf_dir):
    return sampling.per_group(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 3)


@query("SELECT doc_id, lang FROM documents ORDER BY (lang <> 'es')::INT, md5('42:' || doc_id), doc_id LIMIT 100")
def domain_pick(spark, sf_dir):
    return sampling.domain_examples(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", "es", 100)


@query("""WITH r AS (SELECT doc_id, lang, md5('42:' || doc_id) AS k, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents)
SELECT doc_id, lang FROM r ORDER BY (n > 1)::INT, k, doc_id LIMIT 6""")
def diverse_pick(spark, sf_dir):
    return sampling.diverse_examples(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 6)


SHUFFLE_SQL = f"""c AS (SELECT doc_id AS id, {CHOICES_SQL} AS ch, CASE WHEN doc_id % 6 > 0 THEN (doc_id % 6) END AS a FROM documents),
u AS (SELECT id, a, unnest(ch) AS c, generate_subscripts(ch, 1) - 1 AS i FROM c),
o AS (SELECT id, a, string_agg(c, '|' ORDER BY md5(id || ':' || i), i) AS s, list(i ORDER BY md5(id || ':' || i), i) AS p, string_agg(c, '|' ORDER BY i) AS plain FROM u GROUP BY id, a)"""


def with_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = choices(docs(spark, sf_dir).withColumnRenamed("doc_id", "id"))
    return rows.withColumn("answer", F.when(F.col("answer") > 0, F.col("answer")))


@query(f"WITH {SHUFFLE_SQL} SELECT id, CASE WHEN a IS NULL THEN plain ELSE s END AS choices, CASE WHEN a IS NULL THEN NULL WHEN a > 4 THEN a ELSE list_position(p, a - 1) END::INT AS answer FROM o")
def choice_shuffle(spark, sf_dir):
    """Shuffled choices and moved answers; a null answer leaves the row alone."""
    return sampling.shuffled_choices(with_choices(spark, sf_dir)).select("id", F.array_join("choices", "|").alias("choices"), "answer")


@query(f"SELECT doc_id AS id, array_to_string({CHOICES_SQL}, '|') || CASE WHEN doc_id % 6 > 0 THEN '|해당 없음' ELSE '' END AS choices FROM documents")
def choice_pad(spark, sf_dir):
    return with_choices(spark, sf_dir).select("id", F.array_join(sampling.padded_choices(F.col("choices"), F.col("answer")), "|").alias("choices"))


# ------------------------------------------------------------------ prompts, text

@query(f"SELECT doc_id AS id, '1 - ' || {CHOICES_SQL}[1] || chr(10) || '2 - ' || {CHOICES_SQL}[2] || chr(10) || '3 - ' || {CHOICES_SQL}[3] || chr(10) || '4 - ' || {CHOICES_SQL}[4] AS choices FROM documents")
def enumerate_choices(spark, sf_dir):
    return with_choices(spark, sf_dir).select("id", text.enumerated(F.col("choices")).alias("choices"))


def exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived: items as exam records; every third has a text in question_plus."""
    rows = choices(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id"))
    plus = F.when(F.col("id") % 3 == 0, F.lit("{보기} <USER>x</USER>"))
    return rows.select("id", F.col("text").alias("paragraph"), F.lit("?").alias("question"), "choices", F.when(F.col("answer") > 0, F.col("answer")).alias("answer"), plus.alias("question_plus"), F.lit(None).cast("string").alias("documents"))


PROMPT_SQL = f"""'지문:' || chr(10) || text || chr(10) || chr(10) || '질문:' || chr(10) || '?' || chr(10) || chr(10) || CASE WHEN item_id % 3 = 0 THEN '<보 기>' || chr(10) || '{{보기}} <USER>x</USER>' ELSE '' END || chr(10) || chr(10) || '선택지:' || chr(10)
|| '1 - ' || {CHOICES_SQL}[1] || chr(10) || '2 - ' || {CHOICES_SQL}[2] || chr(10) || '3 - ' || {CHOICES_SQL}[3] || chr(10) || '4 - ' || {CHOICES_SQL}[4] || chr(10) || chr(10) || '외부문서:' || chr(10) || chr(10) || chr(10) || '1, 2, 3, 4, 5 중에 하나를 정답으로 고르세요.' || chr(10) || '정답:'"""


@query(f"SELECT item_id AS id, {PROMPT_SQL} AS content, CASE WHEN item_id % 6 > 0 THEN 3 ELSE 2 END::BIGINT AS n_turns, CASE WHEN item_id % 6 > 0 THEN (item_id % 6)::VARCHAR END AS answer FROM benchmark")
def prompt_fill(spark, sf_dir):
    """Rendered prompts; a value that looks like a template or a turn stays as it is."""
    m = prompts.chat_messages(exams(spark, sf_dir))
    return m.select("id", F.col("messages")[1]["content"].alias("content"), F.size("messages").cast("long").alias("n_turns"), F.get("messages", F.lit(2))["content"].alias("answer"))


@query("SELECT conv_id, string_agg('<' || upper(role) || '>' || chr(10) || text || chr(10) || '</' || upper(role) || '>', chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def chat_messages(spark, sf_dir):
    """Conversations as tagged text."""
    turn = lambda t: F.concat(F.lit("<"), F.upper(t["role"]), F.lit(">\n"), t["text"], F.lit("\n</"), F.upper(t["role"]), F.lit(">"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", turn), "\n").alias("rendered"))


@query(f"SELECT item_id AS id, '지문: ' || text || chr(10) || CASE WHEN item_id % 3 = 0 THEN '보기: {{보기}} <USER>x</USER>' || chr(10) ELSE '' END || '질문: ?' || chr(10) || '선택지: ' || array_to_string({CHOICES_SQL}, ', ') || chr(10) || CASE WHEN item_id % 6 > 0 THEN '정답: ' || (item_id % 6) || chr(10) ELSE '' END AS example FROM benchmark")
def example_format(spark, sf_dir):
    return exams(spark, sf_dir).select("id", prompts.example_text().alias("example"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def normalize_ws(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.normalized(F.col("text")).alias("text"))


@query("SELECT page_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(coalesce(html, ''), '\\(cid:\\d+\\)', '', 'g'), '\\s+', ' ', 'g')), '^[\\s.。,]+', '')) AS text FROM pages")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.cleaned(F.col("html")).alias("text"))


@query("SELECT doc_id, trim(concat_ws(' ', nullif(text, ''), nullif(source, ''), lang || ' ' || source, source)) AS text FROM documents")
def augmented_text(spark, sf_dir):
    """Derived: source is the title, lang and source the aliases, source the quotes."""
    c = F.col
    none = F.array().cast("array<string>")
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.augmented(c("text"), c("source"), F.array("lang", "source"), F.array("source"), none).alias("text"))


@query("SELECT event_id AS id, '## k' || chr(10) || (props ->> 'k') AS body FROM events")
def markdown_content(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.markdown(F.col("props")).alias("body"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[가-힣]+|[A-Za-z0-9]+')) AS n FROM documents")
def token_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


# ------------------------------------------------------------------ exam text, derived from tables

CIRCLED = "①②③④⑤"
#: Runs of Latin letters of an item, at least the 12 that its question needs; exams of 20 questions.
WORDS_SQL = "w AS (SELECT item_id, item_id // 20 AS doc, (item_id % 20 + 1)::INT AS q_num, list_concat(regexp_extract_all(text, '[A-Za-z]+'), ['aa', 'bb', 'cc', 'dd', 'ee', 'ff', 'gg', 'hh', 'ii', 'jj', 'kk', 'll']) AS w FROM benchmark)"
HAS_PLUS, HAS_LIST = "q_num % 3 = 0", "q_num % 4 = 0"
CHOICES_TEXT_SQL = "'① ' || w[4] || ' ② ' || w[5] || ' ③ ' || w[6] || ' ④ ' || w[7] || ' ⑤ ' || w[8]"
HEAD_SQL = "w[1] || ' ' || w[2] || '. ' || w[3] || '에 대한 설명으로 옳은 것은?'"
PLUS_SQL = f"CASE WHEN {HAS_PLUS} THEN chr(10) || '<보 기>' || chr(10) || w[9] || ' ' || w[10] || chr(10) ELSE ' ' END"
QUESTION_TEXT_SQL = f"q_num || '. ' || {HEAD_SQL} || {PLUS_SQL} || {CHOICES_TEXT_SQL} || CASE WHEN {HAS_LIST} THEN chr(10) || '1. ' || w[11] ELSE '' END"
ANSWER_SQL = "(item_id % 5 + 1)"


def exam_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, doc, q_num and w, the words of each item."""
    spare = F.array(*[F.lit(c + c) for c in "abcdefghijkl"])
    words = F.concat(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), spare)
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", F.floor(F.col("item_id") / 20).cast("long").alias("doc"), (F.col("item_id") % 20 + 1).cast("int").alias("q_num"), words.alias("w"))


def word(k: int) -> Column:
    return F.col("w")[k - 1]


def question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, q_num and text: a question with choices; every third has a block of views, every fourth a list that looks like a question."""
    numbered = [x for k, c in enumerate(CIRCLED) for x in (F.lit(f"{' ' if k else ''}{c} "), word(4 + k))]
    plus = F.when(F.expr(HAS_PLUS), F.concat(F.lit("\n<보 기>\n"), word(9), F.lit(" "), word(10), F.lit("\n"))).otherwise(" ")
    more = F.when(F.expr(HAS_LIST), F.concat(F.lit("\n1. "), word(11))).otherwise("")
    whole = F.concat(F.col("q_num").cast("string"), F.lit(". "), word(1), F.lit(" "), word(2), F.lit(". "), word(3), F.lit("에 대한 설명으로 옳은 것은?"), plus, *numbered, more)
    return exam_words(spark, sf_dir).select("doc", "q_num", whole.alias("text"))


def joined_texts(rows: DataFrame, order: str, sep: str, head: str = "") -> DataFrame:
    parts = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("x"))
    return parts.select("doc", F.concat(F.lit(head), F.array_join(F.transform("x", lambda t: t["text"]), sep)).alias("text"))


def exam_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_texts(question_texts(spark, sf_dir), "q_num", "\n", "머리말\n")


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer sheets; every number stands twice, the second time with another answer."""
    mark = lambda n: F.element_at(F.array(*map(F.lit, CIRCLED)), (n % 5 + 1).cast("int"))
    line = lambda n: F.concat(F.col("q_num").cast("string"), F.lit(" "), mark(n), F.lit(" 2\n")).alias("text")
    rows = exam_words(spark, sf_dir)
    twice = rows.select("doc", F.col("q_num").alias("k"), line(F.col("item_id"))).unionByName(rows.select("doc", (F.col("q_num") + 100).alias("k"), line(F.col("item_id") + 1)))
    return joined_texts(twice, "k", "")


@query(f"WITH {WORDS_SQL} SELECT doc, q_num, {QUESTION_TEXT_SQL} AS q_text FROM w")
def question_split(spark, sf_dir):
    """Exam texts parted at their numbers; a list's number that isn't above all before it belongs to the question."""
    return exam_text.questions(exam_texts(spark, sf_dir))


BARS = "c"
for _mark in CIRCLED[1:]:
    BARS = f"replace({BARS}, ' {_mark}', '|{_mark}')"
PARSED_SQL = f"""SELECT doc, q_num, CASE WHEN length(w[1] || w[2]) > 4 THEN w[1] || ' ' || w[2] || '.' ELSE {HEAD_SQL} END AS paragraph, {HEAD_SQL} AS question, {CHOICES_TEXT_SQL} || CASE WHEN {HAS_LIST} THEN ' 1. ' || w[11] ELSE '' END AS c,
CASE WHEN {HAS_PLUS} THEN w[9] || ' ' || w[10] ELSE '' END AS question_plus, {ANSWER_SQL}::VARCHAR AS answer FROM w"""


@query(f"WITH {WORDS_SQL}, p AS ({PARSED_SQL}) SELECT doc, q_num, paragraph, question, {BARS} AS choices, question_plus, answer, 'generation-for-nlp-' || (row_number() OVER (ORDER BY doc, q_num) - 1) AS id FROM p")
def question_parse(spark, sf_dir):
    """History exams: passage, question, choices, views and answer of each question, numbered over all exams."""
    rows = exam_text.history_exam(exam_texts(spark, sf_dir), exam_text.answer_sheet(sheets(spark, sf_dir)))
    return exam_text.with_ids(rows).withColumn("choices", F.array_join("choices", "|"))


@query(f"SELECT item_id // 20 AS doc, (item_id % 20 + 1)::INT AS q_num, {ANSWER_SQL}::VARCHAR AS answer FROM benchmark")
def answer_sheet(spark, sf_dir):
    """The first answer of a number counts."""
    return exam_text.answer_sheet(sheets(spark, sf_dir))


def language_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of questions below a passage with their range; exams of 20 end with a part from 35 on, which is another exam's."""
    n = F.col("q_num")
    header = F.concat(F.lit("["), n.cast("string"), F.lit("～"), (n + 1).cast("string"), F.lit("] 다음 글을 읽고 물음에 답하시오.\n"))
    passage = F.when(n % 2 == 1, F.concat(header, F.array_join("w", " "), F.lit(" is the passage they share.\n"))).otherwise("")
    late = F.when(n == 20, F.concat(F.lit("\n[35~36] 다음 글을 읽고 물음에 답하시오.\n35. "), word(1), F.lit("? ① a ② b"))).otherwise("")
    whole = F.concat(passage, n.cast("string"), F.lit(". "), word(1), F.lit(" "), word(2), F.lit("? ① "), word(3), F.lit(" ② "), word(4), late)
    return joined_texts(exam_words(spark, sf_dir).select("doc", "q_num", whole.alias("text")), "q_num", "\n")


LANGUAGE_SQL = f"""l AS (SELECT doc, q_num AS q_from, array_to_string(w, ' ') || ' is the passage they share.' AS paragraph FROM w WHERE q_num % 2 = 1),
lang AS (SELECT w.doc, q_num, paragraph, w[1] || ' ' || w[2] || '?' AS question, '① ' || w[3] || '|② ' || w[4] AS choices, '' AS question_plus, {ANSWER_SQL}::VARCHAR AS answer
FROM w JOIN l ON l.doc = w.doc AND l.q_from = q_num - (q_num + 1) % 2)"""


@query(f"WITH {WORDS_SQL}, {LANGUAGE_SQL} SELECT * FROM lang")
def passage_header_join(spark, sf_dir):
    """Language exams: questions with the passage whose range holds them."""
    out = exam_text.language_exam(language_texts(spark, sf_dir), exam_text.answer_sheet(sheets(spark, sf_dir)))
    return out.withColumn("choices", F.array_join("choices", "|"))


@query(f"""WITH {WORDS_SQL}, {LANGUAGE_SQL}, p AS ({PARSED_SQL}), a AS (SELECT 0 AS file, doc, q_num, question, answer FROM p UNION ALL SELECT 1, doc, q_num, question, answer FROM lang)
SELECT 'generation-for-nlp-' || (row_number() OVER (ORDER BY file, doc, q_num) - 1) AS id, q_num, question, answer FROM a""")
def exams_appended(spark, sf_dir):
    """Rows of several exam files in one table, numbered in the files' order."""
    sheet = exam_text.answer_sheet(sheets(spark, sf_dir))
    parts = [exam_text.history_exam(exam_texts(spark, sf_dir), sheet), exam_text.language_exam(language_texts(spark, sf_dir), sheet)]
    return exam_text.with_ids(exam_text.appended(parts), order=("file", "doc", "q_num")).select("id", "q_num", "question", "answer")


LATIN_SQL = "array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ')"


def latin_words(column: str = "text") -> Column:
    return F.regexp_extract_all(column, F.lit("[A-Za-z]+"), F.lit(0))


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, six of them a file, with their Latin words as text."""
    return docs(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 6).cast("long").alias("doc"), (F.col("doc_id") % 6).cast("int").alias("page"), F.array_join(latin_words(), " ").alias("text"))


@query(f"""WITH p AS (SELECT doc_id // 6 AS doc, doc_id % 6 AS page, doc_id % 11 = 4 AS even, {LATIN_SQL} AS text FROM documents), s AS (SELECT doc, min(page) FILTER (even) AS stop FROM p GROUP BY doc)
SELECT doc, md5(string_agg(text, chr(10) ORDER BY page)) AS text FROM p JOIN s USING (doc) WHERE stop IS NULL OR page < stop GROUP BY doc""")
def page_stop(spark, sf_dir):
    """A file's pages up to the first of the even form."""
    pages = page_rows(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 11 == 4, F.concat(F.lit("짝수형 "), "text")).otherwise(F.col("text")))
    return exam_text.joined_pages(pages.drop("doc_id"), stop_at_even=True).withColumn("text", F.md5("text"))


@query(f"""WITH p AS (SELECT doc_id // 6 AS doc, doc_id % 6 AS page, CASE doc_id % 4 WHEN 0 THEN chr(10) || 'x' || {LATIN_SQL} WHEN 1 THEN 'x' || {LATIN_SQL} || ' ' WHEN 2 THEN 'x' || {LATIN_SQL} || chr(10) ELSE 'x' || {LATIN_SQL} END AS text FROM documents)
SELECT doc, md5(string_agg(text, chr(10) ORDER BY page)) AS text FROM p GROUP BY doc""")
def page_artifacts(spark, sf_dir):
    """Page numbers, form marks and notices go."""
    t, k = F.concat(F.lit("x"), "text"), F.col("doc_id") % 4
    number = F.concat((F.col("doc_id") % 90 + 10).cast("string"), F.lit("\n"), t)
    dirty = F.when(k == 0, number).when(k == 1, F.concat(t, F.lit(" 홀수형"))).when(k == 2, F.concat(t, F.lit("\n이 문제지에 관한 저작권은 누구에게"))).otherwise(t)
    return exam_text.joined_pages(page_rows(spark, sf_dir).withColumn("text", dirty).drop("doc_id")).withColumn("text", F.md5("text"))


@query("SELECT 'run/' || coalesce(arg_max(source, doc_id), '') || '/checkpoint-' || max(doc_id) || CASE WHEN max(doc_id) % 2 = 0 THEN '/' ELSE '' END AS path FROM documents WHERE doc_id % 5 <> 0")
def checkpoint_pick(spark, sf_dir):
    """The path of the highest step; names of another form don't count. Derived: every document names a path, a fifth of them of another form."""
    form, slash = F.when(F.col("doc_id") % 5 == 0, "/other-").otherwise("/checkpoint-"), F.when(F.col("doc_id") % 2 == 0, "/").otherwise("")
    path = F.concat(F.lit("run/"), F.coalesce("source", F.lit("")), form, F.col("doc_id").cast("string"), slash)
    return files.latest_checkpoint(table(spark, sf_dir, "documents").select(path.alias("path")))


@query("SELECT doc_id AS id, CASE doc_id % 4 WHEN 1 THEN 'too few choices' WHEN 2 THEN 'answer out of range' WHEN 3 THEN 'unparsed' END AS reason FROM documents")
def validate_generated(spark, sf_dir):
    """Generated records, some in code fences, some with a choice only, an answer out of range or no record at all."""
    k, first = F.col("doc_id") % 4, F.coalesce(F.get(latin_words(), F.lit(0)), F.lit("q"))
    record = lambda options, answer: F.to_json(F.struct(first.alias("question"), options.alias("choices"), F.lit(answer).alias("answer")))
    two = F.array(first, F.lit("b"))
    fenced = F.concat(F.lit("```json\n"), record(two, 2), F.lit("\n```"))
    raw = F.when(k == 0, fenced).when(k == 1, record(F.array(first), 1)).when(k == 2, record(two, 3)).otherwise(F.concat(F.lit("nothing but "), first))
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), text.unfenced(raw).alias("problems"))
    return literals.parsed_problems(rows).select("id", literals.problem_valid(F.when(F.col("parse_ok"), F.col("p"))).alias("reason"))


from paperloom.plans import parity  # noqa: E402, F401  registers further queries
