"""Quality classifier: a sparse ensemble of rules.

Small boosted trees are grown over text statistics. Each path from a root becomes a rule, a conjunction of
comparisons. A logistic model with an L1 penalty weighs the rules and drops most; what is left is compiled
into one Spark column expression over the statistics, so scoring needs no model object.

Learning is on the driver, on at most ``TRAIN_ROWS`` labelled documents, those with the lowest hash of
doc_id; the statistics of all documents are computed on the executors.

Defined cases: a null text is an empty one and is scored like any other; labels other than 0 and 1 and
labels of unknown documents aren't learned from; several labels of a document each count; a null id is
never held out nor learned from; without labels of both kinds the score is the share of label 1 (0.5
without any); a text of any length is read whole; repeated rows each give a row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from paperloom.llm.common import bound_batches, text_bytes
from paperloom.llm.quality_rules import repeated_words

TRAIN_ROWS, FOLDS, HELD_OUT = 20_000, 3, 1
TREES, DEPTH, RATE, CUTS, SEED = 40, 3, 0.3, 24, 7
PENALTIES = (0.03, 0.01, 0.003, 0.001)
STATS = (
    "n_words", "mean_word", "symbols", "exclaims", "upper", "digits", "bars", "stops", "dup_lines", "repeats", "distinct", "stutter", "lines", "non_ascii",
)
SYMBOLS = b"#*$%&|<>"


def statistics(raw: bytes | None) -> tuple[float, ...]:
    """STATS of one whole text; all but the first two are shares of words, lines or bytes."""
    raw = raw or b""
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stutter = sum(map(bytes.__eq__, words[:-1], words[1:])) if len(words) > 1 else 0
    return (
        float(len(words)), sum(map(len, words)) / n, float(count[list(SYMBOLS)].sum()) / n, float(count[33]) / n, float(count[65:91].sum()) / size,
        float(count[48:58].sum()) / size, float(count[124]) / n, float(count[46]) / n, (len(lines) - len(set(lines))) / max(len(lines), 1),
        repeated_words(words) / n, len(set(words)) / n, stutter / n, len(lines) / n, float(count[128:].sum()) / size,
    )


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns named in keep, and STATS of each row's text."""
    bound_batches(docs.sparkSession)
    rows = docs.select(*keep, text_bytes().alias("_raw"))
    schema = StructType([*rows.schema.fields[:-1], *(StructField(s, DoubleType()) for s in STATS)])

    def run(batches):
        for batch in batches:
            values = np.array([statistics(x) for x in batch.column(batch.num_columns - 1).to_pylist()], float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(values[:, k].copy()) for k in range(len(STATS)))], names=[*keep, *STATS])

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, is greater, cut), all of which must hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, greater, cut in self.conditions:
            out &= (x[:, k] > cut) == greater
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, greater, cut in self.conditions:
            c = F.col(STATS[k]) > F.lit(cut)
            out = out & (c if greater else ~c)
        return out


def simplified(conditions: tuple[tuple[int, bool, float], ...]) -> Rule:
    """The tightest cut for each statistic and side."""
    best: dict[tuple[int, bool], float] = {}
    for k, greater, cut in conditions:
        best[k, greater] = (max if greater else min)(best.get((k, greater), cut), cut)
    return Rule(tuple(sorted((k, g, c) for (k, g), c in best.items())))


def best_cut(x: np.ndarray, target: np.ndarray, statistics: np.ndarray) -> tuple[float, int, float] | None:
    """The gain in squared error, statistic and cut of the best split with five rows or more on each side."""
    best, n, total = (1e-9, -1, 0.0), len(x), target.sum()
    for k in statistics:
        order = np.argsort(x[:, k], kind="stable")
        sums = np.concatenate([[0.0], np.cumsum(target[order])])
        cuts = np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, CUTS)))
        low = np.searchsorted(x[order, k], cuts, "right")  # rows up to each cut
        cuts, low = cuts[(low >= 5) & (low <= n - 5)], low[(low >= 5) & (low <= n - 5)]
        if len(cuts):
            gains = sums[low] ** 2 / low + (total - sums[low]) ** 2 / (n - low) - total * total / n
            at = int(gains.argmax())
            if gains[at] > best[0]:
                best = (float(gains[at]), int(k), float(cuts[at]))
    return best if best[1] >= 0 else None


def grow(x: np.ndarray, target: np.ndarray, depth: int, path: tuple, rules: list[Rule], rng: np.random.Generator) -> list[Rule]:
    """Grows a regression tree and adds a rule for every node below the root. Returns the leaves' rules, which part all rows."""
    found = best_cut(x, target, rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False)) if depth and len(x) >= 20 else None
    if found is None:
        return [simplified(path)]
    _, k, cut = found
    leaves: list[Rule] = []
    for greater in (True, False):
        rows = (x[:, k] > cut) == greater
        here = (*path, (k, greater, cut))
        rules.append(simplified(here))
        leaves += grow(x[rows], target[rows], depth - 1, here, rules, rng)
    return leaves


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def boosted_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    rng, rules = np.random.default_rng(SEED), []
    f = np.zeros(len(x))
    for _ in range(TREES):
        part = rng.random(len(x)) < 0.5
        # step with the leaves of this tree, each towards its rows' mean residual; 4 is the bound of the logistic curve's inverse curvature
        for leaf in grow(x[part], (y - sigmoid(f))[part], DEPTH, (), rules, rng):
            rows = leaf.holds(x)
            if rows.any():
                f[rows] += RATE * 4 * (y[rows] - sigmoid(f[rows])).mean()
    return list(dict.fromkeys(rules))


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient steps; the intercept isn't penalised."""
    n, m = z.shape
    design = np.column_stack([np.ones(n), z])
    bound = np.linalg.norm(design, 2) ** 2 / (4 * n)
    w = v = np.zeros(m + 1)
    w[0] = v[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    t = 1.0
    for _ in range(steps):
        step = v - design.T @ (sigmoid(design @ v) - y) / n / bound
        new = np.sign(step) * np.maximum(np.abs(step) - penalty / bound, 0.0)
        new[0] = step[0]
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1, as an expression over STATS."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """The penalty is the one with the least loss on the last fifth of the rows."""
    if not len(y):
        return Ensemble(0.0, ())
    if y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(p / (1 - p))), ())
    rules = boosted_rules(x, y)
    z = np.column_stack([r.holds(x) for r in rules]).astype(float) if rules else np.empty((len(x), 0))
    cut = max(1, len(y) * 4 // 5)

    def loss(penalty: float) -> float:
        b, w = lasso(z[:cut], y[:cut], penalty)
        p = np.clip(sigmoid(b + z[cut:] @ w), 1e-6, 1 - 1e-6)
        return float(-(y[cut:] * np.log(p) + (1 - y[cut:]) * np.log(1 - p)).mean()) if cut < len(y) else penalty

    b, w = lasso(z, y, min(PENALTIES, key=loss))
    return Ensemble(b, tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if v))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Ensemble:
    """Learn from docs(doc_id, text) and labels(doc_id, quality), of the folds that aren't held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT))
    rank = F.xxhash64("doc_id")
    chosen = known.select("doc_id", F.col("quality").cast("double").alias("y"), rank.alias("rank")).orderBy("rank", "doc_id", "y").limit(train_rows)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ["rank", "doc_id", "y"])  # at most train_rows
    got = rows.orderBy("rank", "doc_id", "y").limit(train_rows).toPandas()
    return fit(got[list(STATS)].to_numpy(float), got["y"].to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs(doc_id, text)."""
    model = train(docs, labels, train_rows)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out")
    return with_statistics(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", held, model.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
