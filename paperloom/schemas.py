"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


EXAM_RAW = _struct(id=_S, paragraph=_S, problems=_S, question_plus=_S)
#: answer is text first: some writers store it as a number, some as text, some as ''.
PROBLEMS_TEXT = _struct(question=_S, choices=T.ArrayType(_S), answer=_S, question_plus=_S)
EXAM_FLAT = _struct(id=_S, paragraph=_S, question=_S, choices=T.ArrayType(_S), answer=_I, question_plus=_S, documents=_S)
KEYWORDS = _struct(quotes=T.ArrayType(_S), related_terms=T.ArrayType(_S))
#: content stays JSON text: its keys are dynamic, ordered, and hold texts or lists.
CORPUS = _struct(doc_id=_S, category=_S, title=_S, aliases=T.ArrayType(_S), rag_matching_keywords=KEYWORDS, content=_S, search_text=_S)
HIT = _struct(doc_id=_S, title=_S, score=_D)
LABELS = _struct(id=_S, query=_S, gold_doc_ids=T.ArrayType(_S), method=_S, bm25_top=T.ArrayType(HIT), vec_top=T.ArrayType(HIT))
PREDICTIONS = _struct(id=_S, answer=_I)
CLASSIFY = _struct(id=_S, label=_S)
MESSAGES = T.ArrayType(_struct(role=_S, content=_S))
ANSWER_SHEET = _struct(subject=_S, year=_I, q_num=_I, answer=_S)
