"""Deterministic splits, samples, quotas and shuffles. All orders come from md5 of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Keys that may be sorted in one place.
GROUP = 20_000


def shuffle_key(seed: int, id_: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")).cast("binary"))


def train_test_split(df: DataFrame, id_: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """df with split: exactly floor(share * n) rows are 'train', those with the lowest keys.

    The border key is found by counting keys by three more of their first characters at a time (16 ** 3 counts, on the
    driver) until the group that holds the border has at most GROUP rows: so only a small part is ever sorted in one place.
    """
    keyed = df.withColumn("_key", shuffle_key(seed, F.col(id_)))
    n = keyed.count()
    want = int(share * n)
    if want <= 0 or want >= n:
        return keyed.withColumn("split", F.lit("train" if want >= n else "test")).drop("_key")
    before, size, group, inside = 0, n, "", keyed.select("_key", id_)
    while size > GROUP and len(group) < 30:
        width = len(group) + 3
        for row in inside.groupBy(F.substring("_key", 1, width).alias("p")).agg(F.count("*").alias("c")).orderBy("p").collect():
            if before + row["c"] >= want:
                break
            before += row["c"]
        group, size = row["p"], row["c"]
        inside = keyed.select("_key", id_).filter(F.col("_key").startswith(group))
    inner = inside.orderBy("_key", id_).limit(want - before)
    edge = inner.agg(F.max(F.struct("_key", id_)).alias("e"))
    last = edge.first()["e"]
    first = (F.col("_key") < last["_key"]) | ((F.col("_key") == last["_key"]) & (F.col(id_) <= last[id_]))
    return keyed.withColumn("split", F.when(first, "train").otherwise("test")).drop("_key")


def sample(df: DataFrame, id_: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the lowest keys; all rows if there are fewer."""
    return df.withColumn("_key", shuffle_key(seed, F.col(id_))).orderBy("_key", id_).limit(n).drop("_key")


def per_group(df: DataFrame, id_: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, with rank."""
    order = Window.partitionBy(group).orderBy(shuffle_key(seed, F.col(id_)), id_)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def domain_examples(df: DataFrame, id_: str, group: str, target: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, those of the target group first, filled up from the others."""
    own = F.when(F.col(group) == target, 0).otherwise(1)
    return df.withColumns({"_own": own, "_key": shuffle_key(seed, F.col(id_))}).orderBy("_own", "_key", id_).limit(n).drop("_own", "_key")


def diverse_examples(df: DataFrame, id_: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """n rows over as many groups as possible: all first picks, then the rest."""
    firsts = per_group(df, id_, group, 1, seed).drop("rank")
    rest = df.join(firsts.select(id_), id_, "left_anti")
    both = firsts.withColumn("_r", F.lit(0)).unionByName(rest.withColumn("_r", F.lit(1)))
    return both.withColumn("_key", shuffle_key(seed, F.col(id_))).orderBy("_r", "_key", id_).limit(n).drop("_r", "_key")


def quotas(counts: DataFrame, target: int) -> DataFrame:
    """domain, n, quota of counts(domain, n): floor shares of target, and the remainder to the largest domain (the first by name on ties)."""
    every = Window.partitionBy(F.lit(0))  # one row a domain
    base = counts.withColumn("quota", F.floor(target * F.col("n") / F.nullif(F.sum("n").over(every), F.lit(0))))
    left, top = F.lit(target) - F.sum("quota").over(every), F.min(F.struct(-F.col("n"), "domain")).over(every)
    rest = F.when(F.col("domain") == top["domain"], left).otherwise(0)
    return base.select("domain", F.col("n").cast("long").alias("n"), (F.col("quota") + rest).cast("long").alias("quota"))


def schedule(quota: DataFrame) -> DataFrame:
    """One row for each record to generate: domain, k."""
    return quota.filter("quota > 0").select("domain", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("k"))


def shuffled_choices(df: DataFrame, id_: str = "id") -> DataFrame:
    """Choices in the order of md5(id:position), and the answer's new number; rows without an answer stay."""
    keyed = F.array_sort(F.transform("choices", lambda c, i: F.struct(F.md5(F.concat(F.col(id_).cast("string"), F.lit(":"), i.cast("string")).cast("binary")).alias("k"), i.alias("i"), c.alias("c"))))
    out = df.withColumn("_s", F.when(F.col("answer").isNotNull(), keyed))
    moved = F.array_position(F.transform("_s", lambda s: s["i"]), F.col("answer") - 1).cast("int")
    return out.withColumns({
        "choices": F.when(F.col("_s").isNull(), F.col("choices")).otherwise(F.transform("_s", lambda s: s["c"])),
        "answer": F.when(F.col("_s").isNull() | (moved == 0), F.col("answer")).otherwise(moved),
    }).drop("_s")


def padded_choices(choices: Column, answer: Column, filler: str = "해당 없음") -> Column:
    """A fifth choice where there is an answer and exactly four choices."""
    return F.when(answer.isNotNull() & (F.size(choices) == 4), F.concat(choices, F.array(F.lit(filler)))).otherwise(choices)
