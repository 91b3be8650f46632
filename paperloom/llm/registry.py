"""The subpackage's queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import alignment, binary_records, bpe, decontaminate, divergence, language_id, minhash, pii, quality_rules, rule_ensemble, transcripts, tree_bpe, warc

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
MULTI_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_verdict"
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_language(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived input: conversations are written as transcripts without roles; see transcripts.as_transcripts."""
    turns = transcripts.recovered_turns(table(spark, sf_dir, "conversations"))
    return turns.select(F.col("conv").try_cast("long").alias("conv_id"), "turn", "line", "role", "n_lines", "rendered")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_records.token_records(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.tree_digests(table(spark, sf_dir, "documents"), MULTI_BPE)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_links(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_language_id, op3_warc, op4_transcripts, op5_minhash, op6_token_records, op7_rule_ensemble, op8_bpe, op9_pii, op10_decontaminate,
        op11_tree_bpe, op12_alignment, op13_divergence,
    )
}

OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls FROM d),
pos AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
win AS (SELECT rid, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g FROM pos),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT p + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
s AS (SELECT w.doc_id, w.host, len(ws)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             (100 * n_symbols > 20 * n_words)::INT + (100 * n_dup_lines > 30 * n_lines)::INT AS n_soft FROM s),
h AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS hk, sum((n_soft > 0)::INT) AS sk FROM r GROUP BY host),
m AS (SELECT sum(hk) / sum(n) AS hm, sum(sk) / sum(n) AS sm, sum(hk::DOUBLE * hk / n) / sum(n) AS hq, sum(sk::DOUBLE * sk / n) / sum(n) AS sq, count(*) / sum(n) AS hr FROM h),
b AS (SELECT *, hq - hm * hm - hm * (1 - hm) * hr AS hb, sq - sm * sm - sm * (1 - sm) * hr AS sb FROM m),
p AS (SELECT *, CASE WHEN hb > 1e-9 THEN least(1e6, greatest(1.0, hm * (1 - hm) / hb - 1)) ELSE 1e6 END AS hw,
             CASE WHEN sb > 1e-9 THEN least(1e6, greatest(1.0, sm * (1 - sm) / sb - 1)) ELSE 1e6 END AS sw FROM b),
v AS (SELECT host, CASE WHEN (hk + hm * hw) / (n + hw) >= 0.9 THEN 'blocked' WHEN (sk + sm * sw) / (n + sw) <= 0.25 * sm THEN 'trusted' ELSE 'normal' END AS host_verdict FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_verdict <> 'blocked' AND n_soft <= (host_verdict = 'trusted')::INT AS kept, host_verdict
FROM r JOIN v USING (host)
"""

OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT b, max(page_id) AS top FROM p WHERE octet_length(b) >= 1000 GROUP BY b)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN m USING (b)
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) >= 4 THEN ws[p:p + 3] ELSE ws END, ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * k >= 80 * (i.n + j.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN m ON m.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
l AS (SELECT lang, sum(total)::BIGINT AS total FROM g GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v))::BIGINT AS p
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT s.lang, s.term, (1 + (1000000000::HUGEINT * (s.n + 2)) // (l.total + 2 * v))::BIGINT AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) s JOIN l USING (lang) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM x WHERE part = 'pair' OR rank <= 10
"""

ORACLE_SQL = {"op1_quality_rules": OP1_SQL, "op3_warc": OP3_SQL, "op5_minhash": OP5_SQL, "op13_divergence": OP13_SQL}
