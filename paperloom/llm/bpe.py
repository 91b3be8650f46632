"""Byte-level BPE by backtracking over longest matches.

A greedy split into longest tokens is wrong for BPE, but a split is the exact result of the merges if and
only if each pair of neighbours is compatible: encoding the two tokens' bytes together gives these same two
tokens. So the encoder takes the longest token at each place (an Aho-Corasick automaton finds the matches
of a piece in one pass), checks it against its left neighbour, falls back to the next shorter match where
the pair is not compatible, and steps back over a place where none is left. A bit per place marks dead
ends, so no place is tried twice and the work is linear.

Decoding looks ids up in an offset table over one block of all token bytes.

Defined cases: a null text is an empty one and gives no ids; the special token's own string in a text is
that token; a piece of any length is encoded whole; repeated rows each give a row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import decoded, map_batches, text_bytes

#: Fixed value: how the format parts a text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units remembered in a worker, in each of two generations (some 80 MB together), and the longest that is remembered.
MEMO_UNITS, MEMO_CHARS = 200_000, 64
MARKS = ".,;:!?"
LONE_SPACE = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
#: Ids decoded at a time.
DECODE_IDS = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BacktrackingBpe:
    """The vocabulary's tables. Inner numbers: a byte is its value, merge i is 256 + i; so a lower number merges first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.tokens = [bytes([b]) for b in range(256)]
        names = {b: c for c, b in alphabet.items()}
        self.ids = [model["vocab"][names[b]] for b in range(256)]
        number = {t: i for i, t in enumerate(self.tokens)}
        self.split = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = number[raw(left)], number[raw(right)]
            number[token := raw(left + right)] = self.merged[pair] = len(self.tokens)
            self.split.append(pair)
            self.tokens.append(token)
            self.ids.append(model["vocab"][left + right])
        self.number = number
        self.trie = ahocorasick.Automaton()
        for token, i in number.items():
            self.trie.add_word(token.decode("latin-1"), i)
        self.trie.make_automaton()
        self.compatible: dict[int, bool] = {}
        # the longest shorter token that begins a token, or -1
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in self.tokens]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        # decoding: bytes of id i are block[offset[i]:offset[i + 1]]
        by_id = {i: t for i, t in zip(self.ids, self.tokens, strict=True)} | {i: s.encode() for s, i in self.special.items()}
        parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.block = np.frombuffer(b"".join(parts), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        self.id_bytes = [int(i).to_bytes(4, "little") for i in self.ids]
        self.marks = {c: self.id_bytes[ord(c)] for c in MARKS}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def is_pair(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens apart. Undoes merges, latest first, and looks for one across the border that would have come earlier."""
        known = self.compatible.get(left << 20 | right)
        if known is not None:
            return known
        a, b, limit = left, right, len(self.tokens)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                answer = False
                break
            # of two equally late merges the left one comes first, so the right one is undone first
            if a > b:
                limit = a
                if a < 256:
                    answer = True
                    break
                a = self.split[a][1]
            else:
                limit = b + 1
                if b >= 256:
                    b = self.split[b][0]
                elif a >= 256:
                    limit, a = a, self.split[a][1]
                else:
                    answer = True
                    break
        if len(self.compatible) >= 1_000_000:
            self.compatible.clear()
        self.compatible[left << 20 | right] = answer
        return answer

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one piece."""
        text, known = piece.encode().decode("latin-1"), self.compatible
        # the automaton's leftmost longest matches follow each other without gaps, as each byte is a token
        matches = [i for _, i in self.trie.iter_long(text)]
        last, good = matches[0], 1
        for token in matches[1:]:
            ok = known.get(last << 20 | token)
            if not (self.is_pair(last, token) if ok is None else ok):
                matches = self.backtrack(text, matches[:good], token)
                break
            last = token
            good += 1
        return b"".join([self.id_bytes[i] for i in matches])

    def backtrack(self, text: str, out: list[int], token: int) -> list[int]:
        """Goes on from out, whose pairs are compatible; token is the longest match that follows."""
        n, tokens, known, shorter = len(text), self.tokens, self.compatible, self.shorter
        dead: set[int] = set()
        at = sum(len(tokens[i]) for i in out)
        while True:
            while token >= 0:
                end = at + len(tokens[token])
                if end not in dead:
                    if not out:
                        break
                    ok = known.get(out[-1] << 20 | token)
                    if self.is_pair(out[-1], token) if ok is None else ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = next(self.trie.iter_long(text, at))[1]
            else:
                dead.add(at)
                token = out.pop()
                at -= len(tokens[token])

    def encode_raw(self, text: str) -> bytes:
        return b"".join([self.encode_piece(x) for x in self.pattern.findall(text)])

    def encode_unit(self, word: str) -> bytes:
        """The ids of a space and word, which must not be empty nor begin or end with white space."""
        if not word or word[0].isspace() or word[-1].isspace():
            raise NotAUnit
        found = self.older.get(word)
        if found is None:
            if word.isalpha():  # letters are one piece, and so is a lone mark after them
                found = self.encode_piece(" " + word)
            elif word[-1] in MARKS and word[:-1].isalpha():
                found = self.memo.get(word[:-1])
                if found is None:
                    return self.encode_unit(word[:-1]) + self.marks[word[-1]]
                found += self.marks[word[-1]]
            else:
                found = self.encode_raw(" " + word)
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_UNITS:
                self.older = dict(self.memo)
                self.memo.clear()
            self.memo[word] = found
        return found

    def encode_plain(self, text: str) -> list[bytes]:
        """A space between two other characters always begins a piece, so the text may be parted there."""
        if not text:
            return []
        memo, make = self.memo, self.encode_unit
        first, *rest = text.split(" ")
        try:
            if first and not first[-1].isspace():
                return [self.encode_raw(first), *[memo.get(x) or make(x) for x in rest]]
        except NotAUnit:
            pass
        first, *rest = LONE_SPACE.split(text)
        return [self.encode_raw(first), *[memo.get(x) or make(x) for x in rest[:-1]], *[self.encode_raw(" " + x) for x in rest[-1:]]]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        for hit in self.special_pattern.finditer(text) if self.special_pattern else ():
            out += self.encode_plain(text[at : hit.start()])
            out.append(np.array([self.special[hit[0]]], "<u4").tobytes())
            at = hit.end()
        out += self.encode_plain(text[at:] if at else text)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; malformed UTF-8 becomes U+FFFD."""
        every, out = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(every), DECODE_IDS):
            part = every[k : k + DECODE_IDS]
            start, size = self.offset[part], self.offset[part + np.uint32(1)] - self.offset[part]
            ends = np.cumsum(size)
            where = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
            out.append(self.block[where].tobytes())
        return b"".join(out).decode("utf-8", "replace").encode()


class NotAUnit(ValueError):
    """White space meets the space at which a text was parted."""


@functools.lru_cache(maxsize=2)
def load(path: str) -> BacktrackingBpe:
    """A worker loads a vocabulary once."""
    return BacktrackingBpe(path)


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and n_tokens for each row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = load(path)
        ids = [encoder.encode(decoded(x)) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"]
        )

    return map_batches(docs.select("doc_id", text_bytes()), run, f"doc_id {kind}, ids binary, n_tokens long")


def bpe_decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens(doc_id, ids, n_tokens) with decoded, the text of ids. Null ids are none."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = load(path)
        texts = [encoder.decode(x or b"").decode() for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "n_tokens", "decoded"])

    return map_batches(tokens.select("doc_id", "ids", F.col("n_tokens").cast("long")), run, f"doc_id {kind}, ids binary, n_tokens long, decoded string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encodes and decodes each text in one pass, so that no ids leave the worker."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, rows = load(path), []
        for raw in batch.column(1).to_pylist():
            ids = encoder.encode(decoded(raw))
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()))
        n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", text_bytes()), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
