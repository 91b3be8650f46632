"""The nested ``problems`` value: JSON, or the repr of a Python dict."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.schemas import PROBLEMS_TEXT


def _value(text: str | None) -> str | None:
    try:
        found = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None
    if isinstance(found, dict):
        return json.dumps({str(k): v for k, v in found.items()}, ensure_ascii=False, default=str)
    return None


@F.pandas_udf(T.StringType())
def literal_as_json(texts: pd.Series) -> pd.Series:
    """Python dict literals as JSON text; null for anything else."""
    return texts.map(_value)


def is_strict_json(text: Column) -> Column:
    """Whether the text is an object in strict JSON; lenient parsing would silently null out None and tuples."""
    strict = F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    return text.startswith("{") & strict.isNotNull() & (F.size(strict) > 0)


def parsed_problems(df: DataFrame, column: str = "problems") -> DataFrame:
    """df with p (struct of PROBLEMS_TEXT) and parse_ok.

    Strict JSON is parsed by built-ins; only other rows go to Python, with ``ast.literal_eval``.
    """
    text = F.col(column)
    rest = F.when(text.isNotNull() & ~F.coalesce(is_strict_json(text), F.lit(False)), text)
    as_json = F.coalesce(F.when(F.coalesce(is_strict_json(text), F.lit(False)), text), literal_as_json(rest))
    out = df.withColumn("_json", as_json).withColumn("p", F.from_json("_json", PROBLEMS_TEXT))
    return out.withColumn("parse_ok", F.col("_json").isNotNull()).drop("_json")


def flattened(df: DataFrame, on_error: str = "default") -> DataFrame:
    """Exam records with one column for each field (schemas.EXAM_FLAT).

    on_error: 'default' gives empty fields, 'skip' leaves the row out, 'raise' stops, 'raw' keeps the text as
    the question. question_plus comes from the nested value, else from the column of that name.
    """
    rows = parsed_problems(df)
    if on_error == "skip":
        rows = rows.filter("parse_ok")
    question = F.coalesce(F.col("p.question"), F.lit(""))
    if on_error == "raw":
        question = F.when(F.col("parse_ok"), question).otherwise(F.col("problems"))
    if on_error == "raise":
        bad = F.raise_error(F.concat(F.lit("cannot parse problems of "), F.col("id"))).cast("string")
        question = F.when(F.col("parse_ok") & F.col("p.question").isNotNull() & F.col("p.choices").isNotNull(), question).otherwise(bad)
    outer = F.col("question_plus") if "question_plus" in df.columns else F.lit(None).cast("string")
    documents = F.col("documents") if "documents" in df.columns else F.lit(None).cast("string")
    return rows.select(
        "id", "paragraph", question.alias("question"), F.coalesce("p.choices", F.array().cast("array<string>")).alias("choices"),
        F.expr("try_cast(p.answer AS INT)").alias("answer"), F.coalesce(F.col("p.question_plus"), outer).alias("question_plus"), documents.alias("documents"),
    )


def packed(question: Column, choices: Column, answer: Column) -> Column:
    """The nested value as JSON text."""
    return F.to_json(F.struct(question.alias("question"), choices.alias("choices"), answer.alias("answer")), {"ignoreNullFields": "false"})


def problem_valid(p: Column) -> Column:
    """Why a generated record is rejected, or null: fields, two choices or more, an answer among them."""
    answer = p["answer"].try_cast("int")
    return (
        F.when(p.isNull(), "unparsed")
        .when(p["question"].isNull() | p["choices"].isNull() | p["answer"].isNull(), "missing field")
        .when(F.size(p["choices"]) < 2, "too few choices")
        .when(answer.isNull() | ~answer.between(1, F.size(p["choices"])), "answer out of range")
    )
