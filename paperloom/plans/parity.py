"""Further queries, one for each operator that the others don't show alone; see queries for the stand-ins."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import schemas
from paperloom.functions import literals, prompts, text
from paperloom.operators import cells, context, corpus, generation, labeling, layout, metrics, models, numbering, retrieval, sampling, vectors
from paperloom.plans import dataset
from paperloom.plans.queries import BM25_CTES, CHOICES_SQL, HY_CTES, VEC_CTES, bm25_hits, bm25_index, choices, docs, exams, items, latin_words, query, r6, table
from paperloom.sources import files
from paperloom.workspace import stored, work_dir

TOKENS_SQL = "regexp_extract_all({}, '[가-힣]+|[A-Za-z0-9]+')"

# ------------------------------------------------------------------ files

@query("SELECT item_id::VARCHAR AS id, md5(text) AS paragraph, md5('{\"q\": \"' || item_id || '\"}') AS problems FROM benchmark")
def csv_round_trip(spark, sf_dir):
    """Exam records to CSV and back, with quotes in them."""
    path = work_dir(spark, "csv")
    rows = items(spark, sf_dir).select(F.col("qid").cast("string").alias("id"), F.col("text").alias("paragraph"), F.format_string('{"q": "%d"}', "qid").alias("problems"), F.lit(None).cast("string").alias("question_plus"))
    files.write_csv(rows, path)
    return files.read_csv(spark, path).select("id", F.md5("paragraph").alias("paragraph"), F.md5("problems").alias("problems"))


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived: every document as a corpus record; null titles for a third of them."""
    d = table(spark, sf_dir, "documents")
    strings = lambda *c: F.array(*c).cast("array<string>")
    keys = F.struct(strings("lang").alias("quotes"), strings().alias("related_terms"))
    content = F.to_json(F.create_map(F.lit("first_part"), F.col("source")))
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("category"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("title"), strings().alias("aliases"), keys.alias("rag_matching_keywords"), content.alias("content"), F.col("text").alias("search_text"))


@query("SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 <> 0 THEN source END AS title, md5(text) AS search_text, lang AS quote FROM documents")
def corpus_file(spark, sf_dir):
    """A corpus written as JSON arrays, overwritten by itself and read again; of equal ids the last counts."""
    path = work_dir(spark, "corpus")
    files.write_corpus(files.corpus_or_empty(spark, path).unionByName(corpus_rows(spark, sf_dir)), path)
    files.write_corpus(files.read_corpus(spark, path), path)
    kept = files.corpus_by_id(files.read_corpus(spark, path))
    return kept.select("doc_id", "title", F.md5("search_text").alias("search_text"), F.col("rag_matching_keywords.quotes")[0].alias("quote"))


@query("""SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 <> 0 THEN source END AS title, md5(trim(concat_ws(' ', nullif(text, ''), CASE WHEN doc_id % 3 <> 0 THEN nullif(source, '') END, lang))) AS text,
'## first part' || chr(10) || source AS body FROM documents""")
def corpus_documents(spark, sf_dir):
    """What an index and a reader see of each corpus record."""
    return corpus.searchable(corpus_rows(spark, sf_dir)).withColumn("text", F.md5("text"))


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN quality = 1 THEN 1 ELSE 0 END::BIGINT AS n_gold FROM labels")
def label_log(spark, sf_dir):
    """A JSON-lines log of labels; a missing list is empty."""
    path = work_dir(spark, "labels")
    gold = F.when(F.col("quality") == 1, F.array(F.col("doc_id").cast("string")))
    files.write_json(table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), gold.alias("gold_doc_ids")), path)
    return files.read_labels(spark, path).select("id", F.size("gold_doc_ids").cast("long").alias("n_gold"))


@query("SELECT item_id::VARCHAR AS id, m AS model, (item_id + length(m) + k) % 5 + 1 AS answer FROM benchmark, (VALUES ('a', 0), ('bb', 1)) v(m, k)")
def prediction_files(spark, sf_dir):
    """One file of predictions for each model."""
    paths = {}
    for k, name in enumerate(("a", "bb")):
        paths[name] = work_dir(spark, "predictions")
        files.write_csv(items(spark, sf_dir).select(F.col("qid").cast("string").alias("id"), ((F.col("qid") + len(name) + k) % 5 + 1).alias("answer")), paths[name])
    return files.read_predictions(spark, paths).withColumn("answer", F.col("answer").cast("long"))


@query(f"WITH {VEC_CTES} SELECT qid, rank, doc_id FROM ve")
def vector_index_file(spark, sf_dir):
    """Vectors stored once and found again, searched by a default k (0)."""
    path = work_dir(spark, "vectors")
    dense = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    vectors.stored_index(spark, path, lambda: dense)
    again = vectors.stored_index(spark, path, lambda: dense.limit(0))
    asked = items(spark, sf_dir).select("qid").join(dense.withColumnRenamed("doc_id", "qid"), "qid")
    return vectors.top_k(asked, again, 0).select("qid", "rank", "doc_id")


@query("SELECT doc_id::VARCHAR AS id, md5(text) AS text, nullif(source, '') AS source FROM documents")
def csv_with_bom(spark, sf_dir):
    """Files that begin with a byte order mark, read back without it."""
    path = work_dir(spark, "csv-bom")
    shape = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text", "source")])
    files.write_csv(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.md5("text").alias("text"), "source"), path, bom=True)
    return files.read_csv(spark, path, shape)


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id::VARCHAR) - 1)::BIGINT AS place FROM documents")
def id_order(spark, sf_dir):
    """The place of each row in order of its id as text, as answers are written."""
    return numbering.numbered(docs(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("id")), ["id"], "place").select("doc_id", "place")


@query("""SELECT doc_id, seed, CASE WHEN row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || doc_id), doc_id) <= floor(0.8 * count(*) OVER (PARTITION BY seed)) THEN 'train' ELSE 'test' END AS split
FROM documents, (VALUES (1), (7), (2026)) s(seed)""")
def seeded_splits(spark, sf_dir):
    """The same split for a seed every time, and others for other seeds."""
    rows = docs(spark, sf_dir).select("doc_id")
    parts = [sampling.train_test_split(rows, "doc_id", 0.8, seed).withColumn("seed", F.lit(seed)) for seed in (1, 7, 2026)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ------------------------------------------------------------------ records, prompts, tokens

@query("""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[A-Za-z]+')[1], 'q') AS w FROM documents)
SELECT doc_id::VARCHAR AS id, policy, CASE WHEN doc_id % 3 = 2 THEN CASE policy WHEN 'default' THEN '' ELSE 'not a record ' || w END ELSE w END AS question
FROM d, (VALUES ('default'), ('skip'), ('raw')) v(policy) WHERE doc_id % 3 < 2 OR policy <> 'skip'""")
def parse_policies(spark, sf_dir):
    """What each policy makes of JSON, a Python literal and other text."""
    k, first = F.col("doc_id") % 3, F.coalesce(F.get(latin_words(), F.lit(0)), F.lit("q"))
    python = F.format_string("{'question': '%s', 'choices': ['a', None]}", first)
    raw = F.when(k == 0, F.format_string('{"question": "%s", "choices": ["a"]}', first)).when(k == 1, python).otherwise(F.concat(F.lit("not a record "), first))
    rows = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.lit("p").alias("paragraph"), raw.alias("problems"))
    parts = [literals.flattened(rows, policy).select("id", F.lit(policy).alias("policy"), "question") for policy in ("default", "skip", "raw")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT doc_id AS id, md5('{{\"question\":\"?\",\"choices\":' || to_json({CHOICES_SQL})::VARCHAR || ',\"answer\":' || (doc_id % 6) || '}}') AS problems FROM documents")
def packed_problems(spark, sf_dir):
    rows = choices(docs(spark, sf_dir).withColumnRenamed("doc_id", "id"))
    return rows.select("id", F.md5(literals.packed(F.lit("?"), F.col("choices"), F.col("answer"))).alias("problems"))


@query("SELECT item_id AS id, 'id,paragraph,problems,question_plus' AS columns, text IS NULL AS has_documents FROM benchmark")
def raw_records(spark, sf_dir):
    """Columns in the stated order, and a null documents column where there is none."""
    rows = items(spark, sf_dir).select(F.lit("{}").alias("problems"), F.lit(None).cast("string").alias("question_plus"), F.col("text").alias("paragraph"), F.col("qid").alias("id"))
    ordered = rows.select(*schemas.EXAM_RAW.names)
    flat = literals.flattened(ordered.withColumn("id", F.col("id").cast("string")))
    return flat.select(F.col("id").cast("long").alias("id"), F.lit(",".join(ordered.columns)).alias("columns"), F.col("documents").isNotNull().alias("has_documents"))


@query("SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN '?' || chr(10) || '{보기} <USER>x</USER>' ELSE '?' END AS question FROM benchmark")
def full_question(spark, sf_dir):
    return exams(spark, sf_dir).select("id", text.full_question(F.col("question"), F.col("question_plus")).alias("question"))


@query("SELECT item_id AS id, 2::BIGINT AS n_turns, 'system,user' AS roles FROM benchmark")
def hidden_answer(spark, sf_dir):
    """Prompts for inference have no turn with the answer."""
    rows = prompts.chat_messages(exams(spark, sf_dir), with_answer=False)
    return rows.select("id", F.size("messages").cast("long").alias("n_turns"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query("SELECT doc_id AS id, md5(trim(text || chr(10) || coalesce(source, ''), E' \\n\\t')) AS query FROM documents")
def query_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(context.query_text(F.col("text"), F.col("source"))).alias("query"))


@query("SELECT doc_id AS id, md5(substring(text, 1, 1500)) AS text FROM documents")
def prefix_cut(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.md5(text.prefix(F.col("text"))).alias("text"))


def word_lengths(texts: pd.Series) -> pd.Series:
    """A tokenizer's stand-in: a token's id is its length."""
    import re

    pattern = re.compile(text.TOKEN)
    return texts.map(lambda x: [len(t) for t in pattern.findall(x)])


RENDERED_SQL = "t AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS x FROM conversations GROUP BY conv_id)"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return rows.select(F.col("conv_id").alias("id"), F.lit(0).alias("answer"), F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))


@query(f"WITH {RENDERED_SQL}, i AS (SELECT conv_id, list_transform({TOKENS_SQL.format('x')}, lambda w: length(w))[1:64] AS ids FROM t) SELECT conv_id AS id, len(ids) AS n, coalesce(list_sum(ids), 0)::BIGINT AS total, len(ids) AS mask FROM i")
def message_tokens(spark, sf_dir):
    """Chat messages through a template and a tokenizer, cut to 64 tokens."""
    out = models.tokenized(conversations(spark, sf_dir), lambda: word_lengths, 64)
    total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, b: a + b)
    return out.select("id", F.size("input_ids").cast("long").alias("n"), total.alias("total"), F.size("attention_mask").cast("long").alias("mask"))


@query(f"WITH {RENDERED_SQL} SELECT conv_id AS id FROM t WHERE len({TOKENS_SQL.format('x')}) <= 64")
def token_length_filter(spark, sf_dir):
    """Without truncation longer rows go."""
    return models.tokenized(conversations(spark, sf_dir), lambda: word_lengths, 64, truncation=False).select("id")


@query(f"""WITH e AS (SELECT item_id % 5 AS target, item_id AS rank, 'd' || item_id % 3 AS domain, '지문: ' || text || chr(10) || CASE WHEN item_id % 3 = 0 THEN '보기: {{보기}} <USER>x</USER>' || chr(10) ELSE '' END || '질문: ?' || chr(10) || '선택지: '
|| array_to_string({CHOICES_SQL}, ', ') || chr(10) || CASE WHEN item_id % 6 > 0 THEN '정답: ' || (item_id % 6) || chr(10) ELSE '' END AS x FROM benchmark WHERE item_id < 25),
n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY rank) AS i FROM e)
SELECT target, 'of ' || string_agg(DISTINCT domain, ', ' ORDER BY domain) || ':' AS head, md5(string_agg(chr(10) || '[예시 ' || i || ' - ' || domain || ']' || chr(10) || x || chr(10), '' ORDER BY i) || 'end') AS rest FROM n GROUP BY target""")
def few_shot_prompt(spark, sf_dir):
    """Examples of a target between a head that names the domains and a tail."""
    rows = exams(spark, sf_dir).filter("id < 25").withColumns({"target": F.col("id") % 5, "rank": F.col("id"), "domain": F.concat(F.lit("d"), (F.col("id") % 3).cast("string"))})
    whole = prompts.few_shot(rows, "of {domains}:", "end")
    at = F.instr("prompt", ":")
    return whole.select("target", F.substring(F.col("prompt"), F.lit(1), at).alias("head"), F.md5(F.substring(F.col("prompt"), at + 1, F.length("prompt"))).alias("rest"))


@query("SELECT DISTINCT doc_id % 4 AS target, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS domains FROM documents GROUP BY ALL")
def domain_lists(spark, sf_dir):
    """Distinct values in order, one list a target."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).alias("target"), "lang")
    return rows.groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("domains"))


@query(f"""SELECT doc_id AS id, array_to_string([CASE WHEN i = doc_id % 6 THEN '✅' WHEN i = doc_id % 5 THEN '❌' ELSE '  ' END || ' ' || i || '. ' || ({CHOICES_SQL})[i] FOR i IN [1, 2, 3, 4]], '|') AS marked FROM documents""")
def choice_markers(spark, sf_dir):
    rows = choices(docs(spark, sf_dir).withColumnRenamed("doc_id", "id"))
    return rows.select("id", F.array_join(metrics.choice_markers(F.col("choices"), F.col("answer"), F.col("id") % 5), "|").alias("marked"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY length(text), md5(text), doc_id) + 99)::BIGINT AS n FROM documents")
def dense_numbers(spark, sf_dir):
    """All documents numbered by length, hash and id, without a task that holds them all."""
    rows = docs(spark, sf_dir).select("doc_id", F.length("text").alias("size"), F.md5("text").alias("hash"))
    return numbering.numbered(rows, ["size", "hash", "doc_id"], start=100).select("doc_id", "n")


#: A page of 40 words in two columns of four lines of five; a word is 40 wide, and every seventh stands so close to the one before that it goes on from it.
PLACED_SQL = """w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) - 1 AS i, unnest(ws) AS t FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents)),
g AS (SELECT doc_id, i // 40 AS page, (i % 40) // 20 AS half, (i % 20) // 5 AS line, i, CASE WHEN i % 5 = 0 OR i % 7 = 0 THEN '' ELSE ' ' END || t AS t FROM w),
l AS (SELECT doc_id, page, half, line, string_agg(t, '' ORDER BY i) AS t FROM g GROUP BY ALL), h AS (SELECT doc_id, page, half, string_agg(t, chr(10) ORDER BY line) AS t FROM l GROUP BY ALL)"""


@query(f"WITH {PLACED_SQL} SELECT doc_id AS doc, page, md5(coalesce(max(t) FILTER (half = 0), '') || chr(10) || coalesce(max(t) FILTER (half = 1), '')) AS text FROM h GROUP BY doc_id, page")
def page_columns(spark, sf_dir):
    """Page text from positioned words; derived: every document's words are laid out in two columns."""
    words = docs(spark, sf_dir).select("doc_id", F.posexplode(latin_words()).alias("i", "text")).withColumn("i", F.col("i").cast("long"))
    i = F.col("i")
    left, place = F.floor(i % 40 / 20) * 300, i % 5
    x0 = left + place * 50 - F.when((i % 7 == 0) & (place > 0), 8).otherwise(0)
    number = lambda c, name: c.cast("double").alias(name)
    placed = words.select(F.col("doc_id").alias("doc"), F.floor(i / 40).alias("page"), F.lit(600.0).alias("width"), number(x0, "x0"), number(left + place * 50 + 40, "x1"), number(F.floor(i % 20 / 5) * 12 + i % 3, "top"), "text")
    return layout.page_texts(placed).select("doc", "page", F.md5("text").alias("text"))


@query("""SELECT item_id::VARCHAR AS name, CASE WHEN item_id % 7 <> 0 THEN md5(text) END AS exam, CASE WHEN item_id % 5 <> 0 THEN md5('sheet ' || item_id) END AS sheet,
(item_id % 7 = 0)::INT + (item_id % 5 = 0)::INT AS n_errors FROM benchmark""")
def file_pairs(spark, sf_dir):
    """A manifest of exam and sheet files, read by tasks; derived: every item is written as two files, of which some are missing."""
    from paperloom.sources.remote import write_bytes

    path = work_dir(spark, "pairs")

    def write(batches):
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if item % 7:
                    write_bytes(f"{path}/exams/{item}.txt", raw)
                if item % 5:
                    write_bytes(f"{path}/sheets/{item}.txt", b"\xef\xbb\xbfsheet %d" % item)
            yield batch.select(["qid"])

    written = stored(items(spark, sf_dir).select("qid", F.col("text").cast("binary").alias("text")).mapInArrow(write, "qid long"), f"{path}/manifest")
    name = F.col("qid").cast("string")
    place = lambda kind: F.concat(F.lit(f"{path}/{kind}s/"), name, F.lit(".txt")).alias(kind)
    found = files.read_pairs(written.select(name.alias("name"), place("exam"), place("sheet")))
    errors = F.when(F.col("error").isNull(), 0).otherwise(F.size(F.split("error", "\n")))
    return found.select("name", F.md5("exam_text").alias("exam"), F.md5("sheet_text").alias("sheet"), errors.cast("int").alias("n_errors"))


# ------------------------------------------------------------------ retrieval

def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "text", F.col("text").alias("body"), "lang")


class OfTable(retrieval.Bm25Retriever):
    """A retriever over a table whose index queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(searchable(spark, sf_dir))
        self.sf_dir = sf_dir

    def build_index(self) -> None:
        self.index = bm25_index(self.corpus.sparkSession, self.sf_dir)


@query(f"WITH {BM25_CTES} SELECT qid, rank, doc_id, round(score, 6) AS score, coalesce(source, '') AS title, lang, md5(text) AS content FROM bm JOIN documents USING (doc_id)")
def search_results(spark, sf_dir):
    """Results with title, metadata and content; a top_k of 0 is the default."""
    found = OfTable(spark, sf_dir).retrieve(items(spark, sf_dir), 0)
    return found.select("qid", "rank", "doc_id", r6("score").alias("score"), "title", F.col("metadata.lang").alias("lang"), F.md5("content").alias("content"))


@query(f"WITH {BM25_CTES} SELECT qid, rank, doc_id FROM bm WHERE rank <= 3")
def dense_fallback(spark, sf_dir):
    """A hybrid search whose embedder fails gives the lexical hits."""

    def broken(rows: DataFrame) -> DataFrame:
        raise ConnectionError("no embedder")

    lexical = OfTable(spark, sf_dir)
    return retrieval.HybridRetriever(lexical, retrieval.VectorRetriever(lexical.corpus, broken)).retrieve(items(spark, sf_dir)).select("qid", "rank", "doc_id")


SHAPE_SQL = "[length({0}) % 97, length(regexp_replace({0}, '[^e]', '', 'g')) % 89]"


def shapes(texts: pd.Series) -> pd.Series:
    """An embedder's stand-in."""
    return texts.map(lambda x: [float(len(x) % 97), float(x.count("e") % 89)])


@query(f"""WITH a AS (SELECT item_id AS qid, {SHAPE_SQL.format('text')} AS v FROM benchmark), d AS (SELECT doc_id, {SHAPE_SQL.format('text')} AS v FROM documents),
r AS (SELECT qid, doc_id, ((a.v[1] - d.v[1]) ** 2 + (a.v[2] - d.v[2]) ** 2)::DOUBLE AS distance FROM a, d)
SELECT qid, doc_id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id) AS rank FROM r QUALIFY rank <= 3""")
def embedded_topk(spark, sf_dir):
    """Texts embedded by a model, then searched."""
    embed = lambda rows: models.embedded(rows, "text", lambda: shapes).select("key", "embedding")
    return retrieval.VectorRetriever(searchable(spark, sf_dir), embed).retrieve(items(spark, sf_dir), 3).select("qid", "rank", "doc_id", F.col("score").alias("distance"))


@query(f"""WITH {BM25_CTES}, a AS (SELECT item_id AS qid, {SHAPE_SQL.format('text')} AS v FROM benchmark WHERE length(text) % 4 <> 0), d AS (SELECT doc_id, {SHAPE_SQL.format('text')} AS v FROM documents),
vd AS (SELECT qid, doc_id, ((a.v[1] - d.v[1]) ** 2 + (a.v[2] - d.v[2]) ** 2)::DOUBLE AS distance FROM a, d), ve AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id) AS rank FROM vd) WHERE rank <= 10),
{HY_CTES} SELECT hy.qid, hy.rank, hy.doc_id, round(CASE WHEN length(q.text) % 4 = 0 THEN bm.score ELSE c END, 6) AS score FROM hy JOIN benchmark q ON item_id = hy.qid LEFT JOIN bm ON bm.qid = hy.qid AND bm.doc_id = hy.doc_id""")
def dense_fallback_rows(spark, sf_dir):
    """A hybrid search where the embedder fails for some texts: those queries have lexical hits and scores, the others of their batch are fused.

    Derived: the embedder raises for a query whose length is a multiple of four, and takes all documents.
    """

    class Marked(retrieval.VectorRetriever):
        """Queries' texts get a mark, so that the embedder knows them."""

        def vectors_of(self, rows: DataFrame, key: str) -> DataFrame:
            return super().vectors_of(rows.withColumn("text", F.concat(F.lit("q" if key == "qid" else "d"), "text")), key)

    def strict(texts: pd.Series) -> pd.Series:
        if any(x[0] == "q" and len(x) % 4 == 1 for x in texts):
            raise ValueError("such a text can't be embedded")
        return shapes(texts.str[1:])

    embed = lambda rows: models.embedded_rows(rows, "text", lambda: strict).select("key", "embedding", "error")
    lexical = OfTable(spark, sf_dir)
    found = retrieval.HybridRetriever(lexical, Marked(lexical.corpus, embed)).retrieve(items(spark, sf_dir))
    return found.select("qid", "rank", "doc_id", r6("score").alias("score"))


@query(f"WITH {VEC_CTES} SELECT qid, rank, doc_id, round(distance, 6) AS distance FROM ve")
def vector_cells(spark, sf_dir):
    """The nearest vectors by a stored index in cells, of which a query reads those that can hold one."""
    dense = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    path = work_dir(spark, "cells")
    cells.build(dense, path)
    asked = items(spark, sf_dir).select("qid").join(dense.withColumnRenamed("doc_id", "qid"), "qid")
    return cells.top_k(asked, cells.open_cells(spark, path), 10).withColumn("distance", r6("distance"))


@query(f"""WITH {BM25_CTES}, c AS (SELECT qid, string_agg('#### ' || rank || '. ' || coalesce(source, '제목 없음') || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS x
FROM bm JOIN documents USING (doc_id) WHERE rank <= 2 GROUP BY qid) SELECT qid, md5(x) AS documents FROM c""")
def rag_batch(spark, sf_dir):
    """The batch pipeline's contexts, without their preface."""
    from paperloom.functions.fixed import CONTEXT_PREFACE

    found = retrieval.RagPipeline(OfTable(spark, sf_dir), 2).run_batch(items(spark, sf_dir))
    return found.select("qid", F.md5(F.substring(F.col("documents"), F.lit(len(CONTEXT_PREFACE) + 1), F.length("documents"))).alias("documents"))


@query(f"""WITH {BM25_CTES}, r AS (SELECT qid, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b, max(doc_id) FILTER (rank = 1) AS top FROM bm GROUP BY qid),
s AS (SELECT qid, top, CASE WHEN b IS NULL THEN true WHEN b <= 0 THEN a > 0 ELSE a / b >= 1.5 END AND contains(lower(concat_ws(' ', d.source, d.text)), lower(split_part(q.text, ' ', 2))) AS sure
      FROM r JOIN benchmark q ON item_id = qid JOIN documents d ON d.doc_id = top),
f AS (SELECT qid, max(doc_id) FILTER (rank = 1) AS x, max(doc_id) FILTER (rank = 2) AS y FROM bm GROUP BY qid)
SELECT qid, CASE WHEN sure THEN top::VARCHAR WHEN qid % 4 = 0 THEN '' ELSE x || ',' || y END AS gold, CASE WHEN sure THEN 'auto_ratio' WHEN qid % 4 = 0 THEN 'uncertain' ELSE 'gpt_fallback' END AS method FROM s JOIN f USING (qid)""")
def fallback_labels(spark, sf_dir):
    """Sure labels, else a chooser's; derived: it names the first three candidates, of which two stay, and fails for every fourth item's text."""
    bodies = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"))
    asked = items(spark, sf_dir)
    known = asked.select("qid", F.split_part("text", F.lit(" "), F.lit(2)).alias("answer_text"))
    shown = asked.withColumn("text", F.concat(F.col("text"), F.lit(" item="), (F.col("qid") % 4).cast("string"), F.lit(";")))

    def choose(prompt: Column) -> Column:
        ids = F.slice(F.regexp_extract_all(prompt, F.lit(r"(?m)^- id: (-?\d+) \|"), F.lit(1)), 1, 3)
        return F.when(prompt.contains(" item=0;"), "I can't say").otherwise(F.to_json(ids))

    out = labeling.labels_with_fallback(bm25_hits(spark, sf_dir), known, bodies, shown, choose)
    return out.select("qid", F.array_join("gold_doc_ids", ",").alias("gold"), "method")


# ------------------------------------------------------------------ models, counts

@query("""WITH r AS (SELECT vec_id % 7 AS k, list_transform([3, 5, 8, 13, 21], lambda i: embedding[i + 1]) AS s FROM embeddings),
p AS (SELECT CASE WHEN k < 5 THEN k ELSE 0 END AS a, list_position(s, list_max(s)) - 1 AS g FROM r),
c AS (SELECT l, sum((a = l AND g = l)::INT) AS tp, sum((a <> l AND g = l)::INT) AS fp, sum((a = l AND g <> l)::INT) AS fn FROM p, (SELECT DISTINCT unnest([a, g]) AS l FROM p) GROUP BY l)
SELECT round(avg(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 9) AS macro_f1 FROM c""")
def training_metric(spark, sf_dir):
    """Macro-F1 in training: the choices' scores at the last place but one; derived: a vector stands for the scores there, and labels are told in several forms, some unknown."""
    label = F.element_at(F.array(*[F.lit(x) for x in ("1", " 2<end_of_turn>\n", "3\n", "4<end_of_turn>5", "5", "none", "")]), (F.col("vec_id") % 7 + 1).cast("int"))
    zero = F.transform("embedding", lambda x: x * 0)
    rows = table(spark, sf_dir, "embeddings").select(F.array(zero, F.col("embedding"), zero).alias("logits"), label.alias("label_text"))
    return metrics.training_metric(rows, [3, 5, 8, 13, 21]).withColumn("macro_f1", F.round("macro_f1", 9))


def public_bpe():
    """A public byte-level tokenizer, for texts in Arrow batches."""
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda texts: pd.Series([x.ids for x in model.encode_batch(list(texts), add_special_tokens=False)], dtype=object)


@query()
def message_tokens_bpe(spark, sf_dir):
    """Chat messages through a template and a real tokenizer, whole."""
    out = models.tokenized(conversations(spark, sf_dir), lambda: public_bpe(), 1 << 20)
    return out.select("id", F.size("input_ids").cast("long").alias("n"), F.xxhash64("input_ids").alias("ids_hash"), (F.size("attention_mask") == F.size("input_ids")).alias("mask"))


@query("SELECT item_id::VARCHAR AS id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || item_id), item_id) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part, CASE WHEN item_id % 6 > 0 THEN (item_id % 6)::INT END AS answer FROM benchmark")
def dataset_parts(spark, sf_dir):
    """A dataset's parts, loaded from CSV and tokenised."""
    path = work_dir(spark, "dataset")
    rows = exams(spark, sf_dir)
    problems = literals.packed(F.col("question"), F.col("choices"), F.col("answer"))
    raw = rows.select(F.col("id").cast("string").alias("id"), "paragraph", problems.alias("problems"), "question_plus")
    files.write_csv(raw, path)
    parts = dataset.ExamDataset(spark, path).preprocess(lambda: word_lengths, 1 << 20)
    return parts["train"].select("id", F.lit("train").alias("part"), "answer").unionByName(parts["test"].select("id", F.lit("test").alias("part"), "answer"))


@query("SELECT doc_id AS id, CASE WHEN length(text) > 300 AND contains(text, 'the') THEN 'A' ELSE 'B' END AS label FROM documents")
def gate_two_stage(spark, sf_dir):
    """The second model sees what the first calls A; derived models look at length and a word."""
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))
    ab = lambda test: F.when(test, "A").otherwise("B")
    return models.two_stage(rows, lambda c: ab(F.length(c) > 300), lambda c: ab(c.contains("the"))).select("id", "label")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'A' ELSE 'B' END AS label FROM documents")
def remote_labels(spark, sf_dir):
    """A classifier's JSON answers; other text, a missing label and no answer are B."""
    answer = F.element_at(F.array(F.lit('{"reason": "x", "label": "a"}'), F.lit('{"label": "B"}'), F.lit("no idea"), F.lit(None).cast("string")), (F.col("id") % 4 + 1).cast("int"))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id")).select("id", models.json_label(answer).alias("label"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 0 THEN 'said ' || doc_id END AS output, doc_id % 5 = 0 AS failed FROM documents")
def generated_texts(spark, sf_dir):
    """A client's texts, asked twice where it fails; derived: it fails for every fifth prompt."""

    def client():
        def call(prompt: str) -> str:
            if int(prompt) % 5 == 0:
                raise TimeoutError(prompt)
            return f"said {prompt}"

        return call

    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("prompt"))
    return models.generated(rows, client, tries=2, wait=0.0).select("id", "output", F.col("error").isNotNull().alias("failed"))


@query("SELECT doc_id AS id, CASE WHEN length(text) % 5 <> 0 THEN 'said ' || md5(text) END AS output, length(text) % 5 = 0 AS failed FROM documents")
def generated_with_log(spark, sf_dir):
    """The same with a log, in two runs, the second of which asks only what the first has no answer to; derived: a client that fails for some prompts."""

    def client():
        def call(prompt: str) -> str:
            if len(prompt) % 5 == 0:
                raise TimeoutError(prompt[:10])
            return f"said {hashlib.md5(prompt.encode()).hexdigest()}"

        return call

    def never():
        def call(prompt: str) -> str:
            raise ConnectionError("asked again")

        return call

    log = work_dir(spark, "log")
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))
    generation.generated_with_log(rows, client, log, every=200, tries=1, wait=0.0)
    found = generation.generated_with_log(rows, never, log, every=200, tries=1, wait=0.0)
    return found.select("id", "output", F.col("error").isNotNull().alias("failed"))


@query("WITH e AS (SELECT vec_id AS id, list_transform(embedding[1:5], lambda x: exp(x::DOUBLE)) AS p FROM embeddings) SELECT id, round(p[1] / list_sum(p), 6) AS first, round(p[5] / list_sum(p), 6) AS last FROM e")
def softmax_scores(spark, sf_dir):
    p = models.softmax(F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), p.alias("p"))
    return rows.select("id", r6(F.col("p")[0]).alias("first"), r6(F.col("p")[4]).alias("last"))


@query("""WITH n AS (SELECT doc_id // 2 AS k FROM documents WHERE doc_id % 3 <> 0), e AS (SELECT doc_id AS k FROM documents WHERE doc_id % 5 = 0), f AS (SELECT DISTINCT k FROM n ANTI JOIN e USING (k))
SELECT (SELECT count(*) FROM e) AS n_existing, (SELECT count(*) FROM n) AS n_new, (SELECT count(*) FROM f) AS n_added, (SELECT count(*) FROM n) - (SELECT count(*) FROM f) AS n_repeated""")
def append_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return corpus.append_counts(d.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("k")), d.filter("doc_id % 3 != 0").select(F.expr("doc_id div 2").alias("k")), "k")
