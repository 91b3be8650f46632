"""Byte-level BPE as a monoid: a piece is encoded by halves, and neighbours are joined.

The merges of a piece always take the pair of neighbours whose joined bytes have the lowest rank, the leftmost
of equals. A row of tokens is their result if and only if each two neighbours are stable, that is, their own
bytes together merge to just these two. (Take the first merge across a border between the two. Until then each
side's merges went as on its own, in the same order, so the two tokens' bytes alone would come to the same
state and take the same merge.) So two encoded halves are joined where their border is stable, and else the
tokens around it are encoded anew in a window that grows, twofold on each side whose outer border isn't stable,
until both are: all tokens outside then stand. Joining is associative, with the empty row as its unit.

A pair's stability is remembered by ids. Windows and leaves are merged plainly, long ones with a heap, so a
piece of any length takes about n log(n)**2 steps at worst. Decoding looks leaves up in a table and concatenates up
the tree, level by level.

Defined cases: a null text is an empty one and gives no ids; there are no special tokens, their strings are
plain text; a piece that is itself a token is that token; a piece of any length is encoded whole; malformed
UTF-8 becomes U+FFFD first; repeated rows each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.bpe import MARKS, PATTERN, BacktrackingBpe
from paperloom.llm.common import decoded, map_batches, text_bytes

#: Bytes that are merged without parting them, and from how many on a heap finds the lowest rank.
LEAF, HEAP_BYTES = 8, 64
#: Pairs whose stability is remembered in a worker.
KNOWN_PAIRS = 1_000_000
#: Ids in a leaf of the decoding tree.
DECODE_IDS = 4096
NEVER = 1 << 40


class TreeBpe(BacktrackingBpe):
    """The ranks of a vocabulary. Parting a text and remembering its words is the other encoder's; the merges are not."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.set_ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))})

    def set_ranks(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.id_bytes = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.stable: dict[int, bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.marks = {c: self.id_bytes[ranks[c.encode()]] for c in MARKS if c.encode() in ranks}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, raw: bytes) -> list[int]:
        """The plain merges of raw."""
        if len(raw) > HEAP_BYTES:
            return self.merge_by_heap(raw)
        get, cut = self.ranks.get, list(range(len(raw) + 1))
        rank = [get(raw[i : i + 2], NEVER) for i in range(len(raw) - 1)]
        while rank and (low := min(rank)) != NEVER:
            i = rank.index(low)
            del cut[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(raw[cut[i] : cut[i + 2]], NEVER)
            if i:
                rank[i - 1] = get(raw[cut[i - 1] : cut[i + 1]], NEVER)
        return [self.ranks[raw[a:b]] for a, b in pairwise(cut)]

    def merge_by_heap(self, raw: bytes) -> list[int]:
        """The same for many bytes: lowest ranks come from a heap, and entries whose parts have changed are passed over."""
        n, get = len(raw), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the parts that begin next and last, by a part's begin
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = after[i]
            if middle >= n or middle < 0 or after[middle] != end:
                continue
            after[i], after[middle] = end, -1
            if end < n:
                before[end] = i
                if (r := get(raw[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (last := before[i]) >= 0 and (r := get(raw[last:end])) is not None:
                heapq.heappush(heap, (r, last, end))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[raw[at : after[at]]])
            at = after[at]
        return out

    def is_stable(self, left: int, right: int) -> bool:
        known = self.stable.get(left << 20 | right)
        if known is None:
            if len(self.stable) >= KNOWN_PAIRS:
                self.stable.clear()
            known = self.stable[left << 20 | right] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def join(self, x: list[int], y: list[int]) -> list[int]:
        """The tokens of both sides' bytes together."""
        if not x or not y or self.is_stable(x[-1], y[0]):
            return x + y
        left = right = 1
        while True:
            window = self.merge(b"".join([self.tokens[i] for i in x[len(x) - left :] + y[:right]]))
            left_stands = left == len(x) or self.is_stable(x[len(x) - left - 1], window[0])
            right_stands = right == len(y) or self.is_stable(window[-1], y[right])
            if left_stands and right_stands:
                return x[: len(x) - left] + window + y[right:]
            left = left if left_stands else min(len(x), 2 * left)
            right = right if right_stands else min(len(y), 2 * right)

    def tree(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF:
            return self.merge(raw)
        half = len(raw) // 2
        return self.join(self.tree(raw[:half]), self.tree(raw[half:]))

    def encode_piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return self.id_bytes[whole] if whole is not None else b"".join([self.id_bytes[i] for i in self.tree(raw)])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        return b"".join(self.encode_plain(text))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids."""
        every = np.frombuffer(ids, "<u4")
        level = [b"".join([self.tokens[i] for i in every[k : k + DECODE_IDS].tolist()]) for k in range(0, len(every), DECODE_IDS)]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


@functools.lru_cache(maxsize=2)
def load(path: str) -> TreeBpe:
    """A worker loads a vocabulary once."""
    return TreeBpe(path)


def tree_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and n_tokens for each row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = load(path)
        ids = [encoder.encode(decoded(x)) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    return map_batches(docs.select("doc_id", text_bytes()), run, f"doc_id {kind}, ids binary, n_tokens long")


def tree_decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens(doc_id, ids, n_tokens) with decoded, the bytes of ids. Null ids are none."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = load(path)
        found = [encoder.decode(x or b"") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=["doc_id", "ids", "n_tokens", "decoded"])

    return map_batches(tokens.select("doc_id", "ids", F.col("n_tokens").cast("long")), run, f"doc_id {kind}, ids binary, n_tokens long, decoded binary")


def tree_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encodes and decodes each text in one pass, so that no ids leave the worker."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, n, of_ids, of_text = load(path), [], [], []
        for raw in batch.column(1).to_pylist():
            ids = encoder.encode(decoded(raw))
            n.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_text.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", text_bytes()), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
