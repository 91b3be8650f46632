"""Host-level quality rules.

Each document is tested against text rules. Failures are summed by host (``source``), each host's rate
is shrunk towards the corpus by a beta prior fitted to all hosts, and the host's verdict is joined back:

* ``blocked``: the shrunk rate of hard failures is at least ``block_rate``; none of its documents stay;
* ``trusted``: the shrunk rate of soft failures is at most ``trust_ratio`` times the prior mean; a
  document may fail one soft rule;
* ``normal``: a document that fails a soft rule goes.

Defined cases: a null text is an empty one and fails; a null source is a host of its own; repeated rows
each count and each get a row; an empty table gives an empty result; a text of any length is read whole, in
memory that grows with its words; further columns, whatever their names, are ignored or, in filtering, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from paperloom.llm.common import any_names, bound_batches, decoded, quoted, stored, text_bytes, words_of, work_dir

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
#: Thresholds. A soft rule fails where the count exceeds that share.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SOFT_SYMBOLS_PERCENT, SOFT_DUP_LINES_PERCENT = 20, 30
BLOCK_RATE, TRUST_RATIO = 0.9, 0.25
#: Hosts that may be sent to all tasks; about 5 MB.
BROADCAST_HOSTS = 100_000


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    if size == n:
        return 0
    two = ids[:-1] * size + ids[1:]
    if size > 1_000_000:  # three factors wouldn't fit 63 bits
        two = np.unique(two, return_inverse=True)[1]
    windows = two[:-1] * size + ids[2:]
    order = np.sort(windows)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    hit = np.isin(windows, again)
    covered = np.zeros(n, bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def text_stats(raw: bytes | None) -> tuple[int, int, int, int, int, int]:
    """The counts of STATS for one whole text."""
    raw = raw or b""
    words = words_of(raw)
    text = decoded(raw)
    word_chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), word_chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words))


def document_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns named in keep, and STATS of each row's text."""
    bound_batches(docs.sparkSession)
    kept = docs.select(*[F.col(c) for c in keep], text_bytes().alias("_raw"))
    names = [f.split()[0] for f in STATS.split(", ")]
    schema = StructType([*kept.schema.fields[:-1], *(StructField(n, LongType()) for n in names)])

    def run(batches):
        for batch in batches:
            rows = [text_stats(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)], names=[*keep, *names])

    return kept.mapInArrow(run, schema)


def with_rules(stats: DataFrame) -> DataFrame:
    """Adds base_failed and n_soft, the number of soft rules that fail."""
    return stats.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    ).withColumn(
        "n_soft",
        (100 * F.col("n_symbols") > SOFT_SYMBOLS_PERCENT * F.col("n_words")).cast("long")
        + (100 * F.col("n_dup_lines") > SOFT_DUP_LINES_PERCENT * F.col("n_lines")).cast("long"),
    )


def prior(rate: float, square: float, hosts_share: float) -> float:
    """The weight in documents of a beta prior with the mean rate, fitted by moments.

    square: the mean over documents of their host's squared rate; hosts_share: hosts by documents. What the
    variance between hosts exceeds that of sampling alone decides. Where nothing exceeds it, the weight is
    10**6 documents, so every host gets the mean.
    """
    within = rate * (1 - rate)
    between = square - rate * rate - within * hosts_share
    return min(1e6, max(1.0, within / between - 1)) if between > 1e-9 else 1e6


def host_verdicts(rules: DataFrame, path: str, block_rate: float = BLOCK_RATE, trust_ratio: float = TRUST_RATIO) -> DataFrame:
    """One row per host: host, n_docs, the shrunk rates hard_rate and soft_rate, and host_verdict. The counts are stored at path, the prior's sums are one row."""
    hosts = stored(
        rules.groupBy("host").agg(
            F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("hard_fails"), F.sum((F.col("n_soft") > 0).cast("long")).alias("soft_fails")
        ),
        f"{path}/counts",
    )
    square = lambda c: F.sum(F.col(c).cast("double") * F.col(c) / F.col("n_docs"))
    n, h, hard, soft, hard_q, soft_q = hosts.agg(F.sum("n_docs"), F.count("*"), F.sum("hard_fails"), F.sum("soft_fails"), square("hard_fails"), square("soft_fails")).first()
    n = n or 1  # no hosts at all
    means = {"hard": (hard or 0) / n, "soft": (soft or 0) / n}
    for name, q in (("hard", hard_q), ("soft", soft_q)):
        weight = prior(means[name], (q or 0.0) / n, h / n)
        hosts = hosts.withColumn(f"{name}_rate", (F.col(f"{name}_fails") + F.lit(means[name] * weight)) / (F.col("n_docs") + F.lit(weight)))
    verdict = F.when(F.col("hard_rate") >= block_rate, "blocked").when(F.col("soft_rate") <= trust_ratio * means["soft"], "trusted").otherwise("normal")
    return stored(hosts.withColumn("host_verdict", verdict), f"{path}/hosts")


def judge(rules: DataFrame, hosts: DataFrame) -> DataFrame:
    """rules with host_verdict and kept. Only hosts are grouped, never their documents.

    hosts is a stored table: it is counted here, and sent to all tasks only up to BROADCAST_HOSTS
    rows. Beyond that it's a shuffled join, whose hot hosts adaptive execution splits.
    """
    side = hosts.select("host", "host_verdict")
    if side.count() <= BROADCAST_HOSTS:
        side = F.broadcast(side)
    allowed = F.when(F.col("host_verdict") == "trusted", 1).otherwise(0)
    return rules.join(side, "host", "left").withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("host_verdict", F.lit("normal")) != "blocked") & (F.col("n_soft") <= allowed)
    )


def hosted(docs: DataFrame) -> DataFrame:
    """docs with host, the document's source ('' where that is null)."""
    return docs.withColumn("host", F.coalesce(F.col("source").cast("string"), F.lit("")))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, host, STATS, base_failed, n_soft, host_verdict and kept for each row of docs(doc_id, text, source).

    The statistics of the one pass over the texts are stored, about 80 bytes a row.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "quality")
    rules = with_rules(stored(document_stats(hosted(docs), ["doc_id", "host"]), f"{path}/stats"))
    return judge(rules, host_verdicts(rules, path))


@any_names("text", "source")
def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    The texts are read twice, first for the hosts and then for the rows: so no row has to be found again
    by an id that may be null or repeated, and no text is shuffled.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "quality")
    hosts = host_verdicts(with_rules(document_stats(hosted(docs.select("text", "source")), ["host"])), path)
    names = docs.columns
    own = docs.select(F.struct(*[F.col(quoted(c)) for c in names]).alias("row"), "text", "source")
    rules = with_rules(document_stats(hosted(own), ["row", "host"]))
    return judge(rules, hosts).filter("kept").select(*[F.col("row").getField(c).alias(c) for c in names])
