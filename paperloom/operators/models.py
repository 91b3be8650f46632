"""Model-backed operators. Models are given by the caller as functions over pandas Series; they run in Arrow batches, loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.answers import best_choice
from paperloom.workspace import bound_batches

#: Characters of texts that a tokenizer takes at a time, as its encodings are a hundred times as large as the ids; a longer text goes alone.
CALL_CHARS = 250_000


def batched(load: Callable[[], Callable[[pd.Series], pd.Series]], kind: str):
    """A column function from a model loader: load() gives a function from texts to values of the SQL type kind."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield model(batch)

    return run


def ab_label(score_a: Column, score_b: Column) -> Column:
    """A only where its score is higher; a tie or a missing score is B."""
    return F.when(score_a > score_b, "A").otherwise("B")


def two_stage(rows: DataFrame, first: Callable[[Column], Column], second: Callable[[Column], Column], prompt: str = "prompt", id_: str = "id") -> DataFrame:
    """rows with label: A where both tests give A. The second model sees only what passed the first."""
    passed = rows.select(id_, prompt).withColumn("_first", first(F.col(prompt))).filter("_first = 'A'")
    needed = passed.withColumn("_second", second(F.col(prompt))).filter("_second = 'A'").select(id_, F.lit("A").alias("label"))
    return rows.join(needed, id_, "left").withColumn("label", F.coalesce("label", F.lit("B")))


def predictions(rows: DataFrame, scores: Column) -> DataFrame:
    """id, answer: the choice with the highest of the scores (array), the first of equals."""
    return rows.select("id", best_choice(scores).alias("answer"))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def chosen_documents(answer_json: Column, limit: int = 2) -> Column:
    """The ids in a chooser's JSON list; anything else is an empty list, and the limit holds."""
    return F.slice(F.coalesce(F.from_json(answer_json, "array<string>"), F.array().cast("array<string>")), 1, limit)


def within_tokens(rows: DataFrame, ids: str, most: int, before_truncation: bool = True) -> DataFrame:
    """Rows of at most so many tokens. With before_truncation=False ids are cut first, and then every row passes."""
    if before_truncation:
        return rows.filter(F.size(ids) <= most)
    return rows.withColumn(ids, F.slice(ids, 1, most))


def json_label(output: Column) -> Column:
    """The label A or B of a classifier's JSON answer; a failure or anything else is B."""
    found = F.upper(F.trim(F.from_json(output, "label string")["label"]))
    return F.when(found == "A", "A").otherwise("B")


def embedded(rows: DataFrame, text: str, load: Callable[[], Callable[[pd.Series], pd.Series]]) -> DataFrame:
    """rows with embedding (array<float>): load() gives a function from texts to vectors, once a worker."""
    return rows.withColumn("embedding", batched(load, "array<float>")(F.col(text)))


def embedded_rows(rows: DataFrame, text: str, load: Callable[[], Callable[[pd.Series], pd.Series]]) -> DataFrame:
    """rows with embedding (array<float>) and error: a text that the model can't take has no vector, and says why; the others of its batch have theirs.

    load() gives a function from texts to vectors, once a worker. A batch that fails is asked again by halves, down to single texts.
    """

    def tried(model: Callable[[pd.Series], pd.Series], texts: pd.Series) -> tuple[list, list]:
        try:
            found = list(model(texts))
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return found, [None if x is not None else "no vector" for x in found]
        except Exception as e:  # noqa: BLE001  a model may raise anything; the row carries it
            if len(texts) == 1:
                return [None], [f"{type(e).__name__}: {e}"]
            half = len(texts) // 2
            (a, b), (c, d) = tried(model, texts.iloc[:half]), tried(model, texts.iloc[half:])
            return a + c, b + d

    @F.pandas_udf("embedding array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            found, errors = tried(model, batch.reset_index(drop=True)) if len(batch) else ([], [])
            yield pd.DataFrame({"embedding": pd.Series(found, dtype=object), "error": pd.Series(errors, dtype=object)})

    return rows.withColumn("_found", run(F.col(text))).select(*rows.columns, "_found.embedding", "_found.error")


def chat_text(messages: Column, add_generation: bool = False) -> Column:
    """Messages as one text: ``<|im_start|>role\\ncontent<|im_end|>\\n`` each, and the head of the answer to come."""
    turn = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    whole = F.array_join(F.transform(messages, turn), "")
    return F.concat(whole, F.lit("<|im_start|>assistant\n")) if add_generation else whole


def in_calls(model: Callable[[pd.Series], pd.Series]) -> Callable[[pd.Series], pd.Series]:
    """The model, asked for CALL_CHARS characters at a time."""

    def run(texts: pd.Series) -> pd.Series:
        sizes = [len(x) if isinstance(x, str) else 0 for x in texts]
        out, at = [], 0
        while at < len(texts):
            end, total = at + 1, sizes[at]
            while end < len(texts) and total + sizes[end] <= CALL_CHARS:
                total += sizes[end]
                end += 1
            out.append(pd.Series([np.asarray(x, np.int64) if x is not None else None for x in model(texts.iloc[at:end].reset_index(drop=True))], dtype=object))
            at = end
        return pd.concat(out, ignore_index=True) if out else pd.Series([], dtype=object)

    return run


def tokenized(rows: DataFrame, load: Callable[[], Callable[[pd.Series], pd.Series]], max_length: int, truncation: bool = True, messages: str = "messages", template: Callable[[Column], Column] = chat_text) -> DataFrame:
    """id, answer, input_ids and attention_mask of rows(id, answer, messages).

    load() gives a tokenizer, a function from texts to lists of ids. With truncation the first max_length ids stay;
    without it, longer rows go. Texts go to the tokenizer in small batches and calls, whatever their number.
    """
    bound_batches(rows.sparkSession)
    ids = rows.select("id", "answer", batched(lambda: in_calls(load()), "array<long>")(template(F.col(messages))).alias("input_ids"))
    return within_tokens(ids, "input_ids", max_length, before_truncation=not truncation).withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))


def generated(rows: DataFrame, client: Callable[[], Callable[[str], str]], prompt: str = "prompt", tries: int = 3, wait: float = 2.0) -> DataFrame:
    """rows with output and error: a client's text for each prompt, asked again up to tries times; client() is called once a task."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("output", T.StringType()), T.StructField("error", T.StringType())])

    def ask(call: Callable[[str], str], text: str) -> tuple[str | None, str | None]:
        import time

        for k in range(tries):
            try:
                return call(text), None
            except Exception as e:  # noqa: BLE001  a remote service may raise anything
                error = str(e)
                if k + 1 < tries:
                    time.sleep(wait)
        return None, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for frame in frames:
            found = [ask(call, x) for x in frame[prompt]]
            yield frame.assign(output=[x[0] for x in found], error=[x[1] for x in found])

    return rows.mapInPandas(run, schema)
