"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to ORDER, frozen after training: in context c with
total count T and D different next bytes, byte s has probability count(s | c) / (T + D) and an escape to
the next shorter context D / (T + D) (method C, without exclusion); below order 0 all 256 bytes are equal.
A context never seen passes on without cost. The code length of a text is the sum over its bytes, exact to
floating point, and the language that codes it shortest is predicted; the score is its posterior under
equal priors.

With frozen statistics, a byte's cost depends only on itself and the ORDER bytes before it. So each
different group of bytes is scored once in a worker and remembered, and a text costs a lookup per byte.

Training reads whole documents of a sample of at most ``TRAIN_BYTES`` expected bytes over all languages,
shared evenly, chosen by a hash of doc_id; documents of more than LARGEST bytes aren't in the sample. The
model is then bounded: no more byte groups than training bytes.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text where
nothing could be learned; ties go to the first language by name; a null id is never held out nor learned
from; repeated rows each count; a text of any length is scored whole, CHUNK bytes at a time; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import bound_batches, map_batches, text_bytes

ORDER = 4
TRAIN_BYTES, LARGEST = 16_000_000, 1_000_000
#: Byte groups that a worker remembers, and bytes that are scored at a time.
MEMO_GROUPS, CHUNK = 1_000_000, 1 << 20
FOLDS = 5
LETTER = regex.compile(r"\p{L}")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def groups(raw: bytes) -> np.ndarray:
    """For each byte the number made of the ORDER bytes before it and itself; zero bytes stand before a text."""
    data = np.frombuffer(bytes(ORDER) + raw, np.uint8).astype(np.uint64)
    out = data[: len(raw)].copy()
    for k in range(1, ORDER + 1):
        out <<= np.uint64(8)
        out |= data[k : k + len(raw)]
    return out


class ContextTree:
    """One language's frozen costs in bits, by order."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.orders = []
        for j in range(ORDER + 1):
            seen, inverse = np.unique(codes & np.uint64((1 << 8 * (j + 1)) - 1), return_inverse=True)
            count = np.bincount(inverse, counts)
            contexts, of = np.unique(seen >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(of, count), np.bincount(of)
            self.orders.append((seen, -np.log2(count / (total + kinds)[of]), contexts, -np.log2(kinds / (total + kinds))))

    def costs(self, codes: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for j in range(ORDER, -1, -1):
            seen, cost, contexts, escape = self.orders[j]
            own = codes[open_] & np.uint64((1 << 8 * (j + 1)) - 1)
            at = np.minimum(np.searchsorted(seen, own), len(seen) - 1)
            hit = seen[at] == own
            out[open_[hit]] += cost[at[hit]]
            open_, own = open_[~hit], own[~hit] >> np.uint64(8)
            at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            hit = contexts[at] == own
            out[open_[hit]] += escape[at[hit]]
        out[open_] += 8.0
        return out


class Scorer:
    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.names = sorted(counts)
        self.trees = [ContextTree(*counts[n]) for n in self.names]
        self.known, self.table = np.empty(0, np.uint64), np.empty((0, len(self.names)))

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """A row of costs, one for each language, for each of some different codes."""
        at = np.minimum(np.searchsorted(self.known, codes), max(len(self.known) - 1, 0))
        new = codes[self.known[at] != codes] if len(self.known) else codes
        if len(new):
            if len(self.known) > MEMO_GROUPS:
                self.known, self.table = self.known[:0], self.table[:0]
                return self.lookup(codes)
            rows = np.stack([t.costs(new) for t in self.trees], axis=1)
            keys = np.concatenate([self.known, new])
            order = np.argsort(keys, kind="stable")
            self.known, self.table = keys[order], np.concatenate([self.table, rows])[order]
            at = np.searchsorted(self.known, codes)
        return self.table[at]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.names)))
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if held:
                inverse, different = pd.factorize(np.concatenate([x for _, x in held]))
                costs = self.lookup(different)
                rows = np.repeat([k for k, _ in held], [len(x) for _, x in held])
                for lang in range(len(self.names)):
                    out[:, lang] += np.bincount(rows, costs[inverse, lang], minlength=len(texts))
                held.clear()

        size = 0
        for k, raw in enumerate(texts):
            every = groups(raw)
            for i in range(0, len(every), CHUNK):
                part = every[i : i + CHUNK]
                held.append((k, part))
                size += len(part)
                if size >= CHUNK:
                    flush()
                    size = 0
        flush()
        return out

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        has = [bool(x) and bool(LETTER.search(x.decode("utf-8", "replace"))) for x in texts]
        lengths = self.code_lengths([x if ok else b"" for x, ok in zip(texts, has, strict=True)]) if self.names else None
        for k, ok in enumerate(has):
            if not ok or lengths is None:
                names.append("und")
                scores.append(0.0)
            else:
                best = int(np.argmin(lengths[k]))
                names.append(self.names[best])
                scores.append(1.0 / float(np.exp2(np.maximum(lengths[k, best] - lengths[k], -1000.0)).sum()))
        return names, scores


def train(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> Scorer:
    """Counts byte groups by language on the executors and gathers the bounded counts."""
    bound_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0)).select("doc_id", "text", "lang")
    rows = rows.filter(F.octet_length("text") <= LARGEST)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    share = {k: min(1.0, train_bytes / len(sizes) / n) if n else 0.0 for k, n in sizes.items()}
    if not share:
        return Scorer({})
    part = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(math.ceil(v * (1 << 20))))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part[F.col("lang")])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts: dict[str, list[np.ndarray]] = {}
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(groups(raw))
        out = []
        for lang, parts in texts.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            out.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out and sum(x.num_rows for x in out) else None

    counted = map_batches(sample.select("lang", text_bytes()), count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    return Scorer({lang: (g["code"].to_numpy().astype(np.uint64), g["n"].to_numpy().astype(np.float64)) for lang, g in counted.groupby("lang")})


def predict_language(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs(doc_id, text, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, train_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out")
    return map_batches(docs.select("doc_id", held, text_bytes()), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
