"""Chat prompts. A template is parsed once on the driver and becomes one concatenation, so values are never parsed again."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.fixed import CHOOSER, DOCUMENT_GATE, HISTORY_GATE, NO_CHOICES, TEMPLATES
from paperloom.functions.text import enumerated, stripped

FIELD = re.compile(r"\{(\w+)\}")
BLOCK = re.compile(r"<(SYSTEM|USER|ASSISTANT)>(.*?)</\1>", re.DOTALL)


def template(name: str, folder: str | None = None) -> str:
    """A template's text, by name or from a folder; a missing one is an error."""
    if folder is None:
        if name not in TEMPLATES:
            raise FileNotFoundError(f"no template named {name}")
        return TEMPLATES[name]
    path = Path(folder) / f"{name}.txt"
    if not path.exists():
        raise FileNotFoundError(path)
    return path.read_text(encoding="utf-8")


def filled(text: str, values: dict[str, Column]) -> Column:
    """One pass over the template; a field without a value is an error, a null value is empty."""
    parts = FIELD.split(text)
    missing = set(parts[1::2]) - set(values)
    if missing:
        raise KeyError(f"no value for {sorted(missing)}")
    return F.concat(*[F.coalesce(values[x], F.lit("")) if k % 2 else F.lit(x) for k, x in enumerate(parts)])


def messages(text: str, values: dict[str, Column], answer: Column | None = None) -> Column:
    """The template's blocks as array<struct<role, content>>, with the answer as a last turn where it isn't null or empty."""
    turns = [F.struct(F.lit(role.lower()).alias("role"), stripped(filled(body, values)).alias("content")) for role, body in BLOCK.findall(text)]
    out = F.array(*turns)
    if answer is None:
        return out
    text_answer = answer.cast("string")
    last = F.array(F.struct(F.lit("assistant").alias("role"), text_answer.alias("content")))
    return F.when(text_answer.isNull() | (text_answer == ""), out).otherwise(F.concat(out, last))


def exam_values(documents: Column | None = None) -> dict[str, Column]:
    """The fields of an exam record (schemas.EXAM_FLAT) as template values."""
    plus = F.when(F.col("question_plus").isNotNull() & (F.col("question_plus") != ""), F.concat(F.lit("<보 기>\n"), F.col("question_plus"))).otherwise(F.lit(""))
    docs = F.coalesce(F.col("documents") if documents is None else documents, F.lit(""))
    return {"paragraph": F.col("paragraph"), "question": F.col("question"), "question_plus": plus, "choices": enumerated(F.col("choices")), "documents": docs, "context": docs}


def chat_messages(exams: DataFrame, name: str = "base", with_answer: bool = True, folder: str | None = None) -> DataFrame:
    """exams with messages; with_answer=False keeps the answer out of the prompt."""
    return exams.withColumn("messages", messages(template(name, folder), exam_values(), F.col("answer") if with_answer else None))


def example_text() -> Column:
    """One record as a few-shot example."""
    given = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\n"))
    return F.concat(
        line("지문", F.coalesce("paragraph", F.lit(""))), F.when(given("question_plus"), line("보기", F.col("question_plus"))).otherwise(F.lit("")),
        line("질문", F.col("question")), line("선택지", enumerated(F.col("choices"), "comma")),
        F.when(F.col("answer").isNotNull(), line("정답", F.col("answer").cast("string"))).otherwise(F.lit("")),
    )


def few_shot(examples: DataFrame, head: str, tail: str) -> DataFrame:
    """One prompt for each target of examples(target, rank, domain, and an exam record): numbered examples between head and tail.

    head may name {domains}, the sorted distinct domains; a target has a handful of examples.
    """
    shown = examples.select("target", "rank", "domain", example_text().alias("text"))
    grouped = shown.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("rank", "domain", "text"))).alias("x"))
    body = F.array_join(F.transform("x", lambda e, i: F.concat(F.lit("\n[예시 "), (i + 1).cast("string"), F.lit(" - "), e["domain"], F.lit("]\n"), e["text"], F.lit("\n"))), "")
    domains = F.array_join(F.array_sort(F.array_distinct(F.transform("x", lambda e: e["domain"]))), ", ")
    return grouped.select("target", F.concat(filled(head, {"domains": domains}), body, F.lit(tail)).alias("prompt"))


def gate_prompts(paragraph: Column, question: Column, choices: Column) -> tuple[Column, Column]:
    """The prompts of the two gate stages: is it a history problem, and does it need a document."""
    listed = F.when(F.size(choices) > 0, enumerated(choices, "dot")).otherwise(F.lit(NO_CHOICES))
    values = {"paragraph": paragraph, "question": question, "choices": listed}
    return filled(HISTORY_GATE, values), filled(DOCUMENT_GATE, values)


def chooser_prompt(query: Column, candidates: Column, limit: int = 2) -> Column:
    """The prompt that asks for the ids of fitting documents; candidates is an array of (doc_id, title, snippet)."""
    line = lambda c: F.concat(F.lit("- id: "), c["doc_id"], F.lit(" | title: "), F.coalesce(c["title"], F.lit("")), F.lit(" | snippet: "), F.coalesce(c["snippet"], F.lit("")))
    return filled(CHOOSER, {"limit": F.lit(str(limit)), "query": query, "candidates": F.array_join(F.transform(candidates, line), "\n")})
