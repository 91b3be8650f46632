"""Profiles and answer quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORRECT, WRONG = "O", "X"


def accuracy(rows: DataFrame, truth: str = "answer", guess: str = "predict", missing: str = "exclude") -> DataFrame:
    """accuracy of rows; missing='exclude' leaves rows without a truth out, 'first' takes the first class for it."""
    t = F.coalesce(F.col(truth), F.lit(1)) if missing == "first" else F.col(truth)
    return rows.filter(t.isNotNull()).agg(F.avg(F.coalesce((t == F.col(guess)), F.lit(False)).cast("double")).alias("accuracy"))


def choice_markers(choices: Column, answer: Column, predict: Column) -> Column:
    """Each choice as a line with its number: a check mark at the answer, a cross at another prediction."""
    sign = lambda i: F.when(i + 1 == answer, "✅").when(i + 1 == predict, "❌").otherwise("  ")
    return F.transform(choices, lambda c, i: F.concat(sign(i), F.lit(" "), (i + 1).cast("string"), F.lit(". "), c))


def confusion(rows: DataFrame, truth: str = "answer", guess: str = "predict") -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def class_scores(rows: DataFrame, truth: str = "answer", guess: str = "predict") -> DataFrame:
    """label, tp, fp, fn, f1 for each label that is a truth or a guess; 0 where F1 is undefined. One pass over the rows."""
    cells = confusion(rows.filter(F.col(truth).isNotNull()), truth, guess)
    same = F.col("truth").eqNullSafe(F.col("guess"))
    parts = cells.select(
        F.explode(F.array(
            F.struct(F.col("truth").alias("label"), F.when(same, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(~same, F.col("n")).otherwise(0).alias("fn")),
            F.struct(F.col("guess").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(~same, F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")),
        )).alias("c")
    ).select("c.*").filter("label is not null")
    sums = parts.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def macro_f1(rows: DataFrame, truth: str = "answer", guess: str = "predict") -> DataFrame:
    return class_scores(rows, truth, guess).agg(F.avg("f1").alias("macro_f1"))


#: The labels a model is trained on, and what ends a turn.
TRAINED_LABELS, END_OF_TURN = "12345", "<end_of_turn>"


def choice_logits(logits: Column, ids: list[int]) -> Column:
    """The scores of the choices' tokens at the last place but one, where the answer is told (the end token is last); null where there is none."""
    place = F.try_element_at(logits, F.lit(-2))
    return F.when(place.isNotNull(), F.array(*[F.get(place, F.lit(i)) for i in ids]))


def decoded_label(text: Column) -> Column:
    """The index, from 0, of a label that is told before the turn's end; any other text counts as the first."""
    told = F.trim(F.regexp_replace(F.split_part(text, F.lit(END_OF_TURN), F.lit(1)), r"(?U)^\s+|\s+$", ""))
    return F.when(told.rlike(f"^[{TRAINED_LABELS}]$"), told.try_cast("int") - 1).otherwise(0)


def training_metric(rows: DataFrame, ids: list[int], logits: str = "logits", label: str = "label_text") -> DataFrame:
    """One row, macro_f1, of rows(logits: scores by place and token, label_text). Of equal scores the first choice counts."""
    scores = choice_logits(F.col(logits), ids)
    marked_ = rows.select(decoded_label(F.col(label)).alias("answer"), scores.alias("_scores"))
    guess = F.array_position("_scores", F.array_max("_scores")) - 1
    return macro_f1(marked_.withColumn("predict", guess.cast("int")))


def marked(rows: DataFrame, truth: str = "answer", guess: str = "predict") -> DataFrame:
    """rows with correct, O or X."""
    return rows.withColumn("correct", F.when(F.col(truth) == F.col(guess), CORRECT).otherwise(WRONG))


def wrong(rows: DataFrame, truth: str = "answer", guess: str = "predict") -> DataFrame:
    """Rows whose answers differ; a missing one differs from everything, also from a missing one."""
    return rows.filter(~F.coalesce(F.col(truth) == F.col(guess), F.lit(False)))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """value, n, share of values that aren't null."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def length_stats(rows: DataFrame, length: Column) -> DataFrame:
    """mean, median, min, max and sample deviation. The median sorts counts of lengths, not lengths."""
    return rows.select(length.alias("x")).agg(
        F.avg("x").alias("mean"), F.median("x").alias("median"), F.min("x").cast("long").alias("min"), F.max("x").cast("long").alias("max"), F.stddev_samp("x").alias("std")
    )


def histogram(rows: DataFrame, value: Column, bins: int) -> DataFrame:
    """bin, n: equal widths from the least to the greatest value, the last bin closed; equal values all fall into bin 0."""
    x = rows.select(value.cast("double").alias("x")).filter("x is not null")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    share = F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    place = F.least(F.floor(share * bins), F.lit(bins - 1))
    return x.crossJoin(F.broadcast(ends)).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def range_counts(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """bin, n, percent of all rows for each range (low, high]; the last is open, and empty ones are kept."""
    spark = rows.sparkSession
    names = [f"({a:g}, {b:g}]" for a, b in zip(edges, [*edges[1:], float("inf")], strict=True)]
    case = F.lit(None).cast("int")
    for k, low in reversed(list(enumerate(edges))):
        case = F.when((value > low) & (F.lit(k == len(edges) - 1) | (value <= (edges[k + 1] if k + 1 < len(edges) else 0))), F.lit(k)).otherwise(case)
    counts = rows.groupBy(case.alias("k")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    every = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, bin string")
    return every.join(counts, "k", "left").crossJoin(F.broadcast(total)).select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(100.0 * F.coalesce("n", F.lit(0)), F.col("total")), F.lit(0.0)).alias("percent"))


def share_below(rows: DataFrame, value: Column, limit: float) -> DataFrame:
    return rows.agg((F.avg(F.when(value < limit, 1.0).otherwise(0.0)) * 100).alias("percent"))


def profile(rows: DataFrame) -> DataFrame:
    """column, kind, n_rows, n_nulls of each column, in one pass."""
    counts = rows.agg(F.count("*").alias("n"), *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"n{k}") for k, c in enumerate(rows.columns)])
    parts = [F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col("n").alias("n_rows"), F.coalesce(f"n{k}", F.lit(0)).cast("long").alias("n_nulls")) for k, (c, kind) in enumerate(rows.dtypes)]
    return counts.select(F.explode(F.array(*parts)).alias("c")).select("c.*")
