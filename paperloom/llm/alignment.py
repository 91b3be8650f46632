"""Cross-tokenizer alignment over whole Arrow batches.

Each text, with a space before it, is encoded by two tokenizers, A (byte-level BPE) and B (pieces with byte
fallback). The tokens of all documents in a batch are laid end to end over the batch's bytes, and the ends of A and of B
are counted once by byte offset. Offsets where both end cut the tokens into groups; each offset where
either ends closes one link, a pair of an A and a B token whose byte ranges overlap. Prefix sums over offsets,
taken at the documents' borders, give each document's numbers.

The batch's rows are stored with each document's distinct pairs of ids. Pairs are counted over the corpus in Spark,
map-side first; the highest count of each B id is a table no longer than B's vocabulary. The counts then go back to
the documents: sent to all tasks while there are no more than BROADCAST_PAIRS, counted first, else by a join on
the pair in which the pairs of common ids are dealt in SALTS parts.

Defined cases: a null or empty text has no tokens, nor has one whose A or B bytes differ from it (a U+2581 in it, for
instance, or malformed UTF-8 that became U+FFFD); such rows have zeros and no groups. Strings of special tokens are plain text. A text
of any length is aligned whole, in memory that grows with it; repeated rows and equal or null ids each give a row and
each count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import bpe
from paperloom.llm.common import decoded, map_batches, stored, text_bytes, work_dir

#: Bytes of text that are laid end to end at a time; a longer text is taken alone.
BATCH_BYTES = 4 << 20
#: Units that a worker remembers, and characters in them, in each of two generations.
MEMO_UNITS, MEMO_CHARS = 300_000, 8_000_000
#: Counted pairs that may be sent to all tasks, about 60 MB there.
BROADCAST_PAIRS = 1_000_000
#: Parts that each pair is dealt in where both sides are shuffled.
SALTS = 16
#: A pair of ids is one number: A's id above, B's below; in a batch a document's place, below 2 ** 23, stands above both.
SHIFT = 20
SPACE = "▁"
UNITS = re.compile(" ( *[^ ]*)")
BYTE = re.compile("<0x([0-9A-F]{2})>")


class NotTheText(ValueError):
    """The pieces' bytes are not those of the text."""


class PieceEncoder:
    """B's ids of a text. No piece has a space after another character, so a space with the word after it, and further spaces between them, is encoded apart from the rest."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE in name.lstrip(SPACE) for name in names):
            raise ValueError(f"{path}: a piece reaches over a space")
        as_bytes = lambda name: bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(name)) else name.replace(SPACE, " ").encode()
        self.tokens = [as_bytes(name) for name in names]
        self.space = [self.model.piece_to_id(SPACE)]

    def unit(self, unit: str) -> bytes:
        """The ids of a space and unit, as little-endian unsigned 32-bit integers; the model puts the space itself, but not before nothing."""
        ids = self.model.encode(unit) if unit else self.space
        if b"".join(map(self.tokens.__getitem__, ids)) != b" " + unit.encode():
            raise NotTheText(unit)
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of text, which the model begins with a space of its own. Raises where their bytes differ from a space and text."""
        return b"".join(map(self.unit, units_of(text)))


def units_of(text: str) -> list[str]:
    """What follows each space of a space and text, further spaces included; nothing for no text."""
    units = text.split(" ") if text else []
    return UNITS.findall(" " + text) if "" in units else units


def table_of(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of bytes for each token, filled up with zeros, and where they are its own."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    own = np.arange(size.max()) < size[:, None]
    rows = np.zeros(own.shape, np.uint8)
    rows[own] = np.frombuffer(b"".join(tokens), np.uint8)
    return rows, own


class Aligner:
    """Both vocabularies' tables; digits hold each id's decimal with either mark that may follow it, B's entries after A's."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = bpe.BacktrackingBpe(path_a), PieceEncoder(path_b)
        names = [b""] * (max(self.a.ids) + 1)
        for i, token in zip(self.a.ids, self.a.tokens, strict=True):
            names[i] = token
        self.size_a, self.size_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (names, self.b.tokens))
        self.first_b = 2 * len(names)
        digits = lambda n, marks: [str(i).encode() + mark for i in range(n) for mark in marks]
        entries = digits(len(names), (b",", b"|")) + digits(len(self.b.tokens), (b",", b";"))
        self.digits, self.own = table_of(entries)
        self.digit_size = self.own.sum(1)

        # A's and B's ids of a space and a unit; A's are None where the unit's white space meets the space
        self.memo: dict[str, tuple[bytes | None, bytes]] = {}
        self.older: dict[str, tuple[bytes | None, bytes]] = {}
        self.chars = 0

    def pair(self, unit: str) -> tuple[bytes | None, bytes]:
        found = self.older.get(unit)
        if found is None:
            apart = unit and not unit[0].isspace() and not unit[-1].isspace()
            found = self.a.encode_raw(" " + unit) if apart else None, self.b.unit(unit)
        if len(self.memo) >= MEMO_UNITS or self.chars >= MEMO_CHARS:
            self.older, self.memo, self.chars = self.memo, {}, 0
        self.memo[unit] = found
        self.chars += len(unit)
        return found

    def tokens(self, text: str) -> tuple[int, bytes, bytes]:
        """The bytes of a space and text, and both sides' ids; nothing where B's bytes differ from it. A has a token for each byte, and joins them only."""
        units = units_of(text)
        try:
            found = [pair or self.pair(unit) for unit, pair in zip(units, map(self.memo.get, units), strict=True)]
        except NotTheText:
            found = []
        if not found:
            return 0, b"", b""
        a = [x for x, _ in found]
        # a space between two other characters begins a piece of A's, so units between such are apart
        return len(text.encode()) + 1, b"".join(self.a.encode_plain(" " + text) if None in a else a), b"".join([y for _, y in found])


class Aligned:
    """The alignment of a batch's documents, each given as tokens() returns it."""

    def __init__(self, tables: Aligner, rows: list[tuple[int, bytes, bytes]]):
        self.tables, self.n = tables, len(rows)
        after = lambda sizes: np.concatenate([[0], np.cumsum(np.fromiter(sizes, np.int64, len(rows)))])
        # where each document begins and the last one ends, in bytes and in tokens
        byte, self.at_a, self.at_b = after(r[0] for r in rows), after(len(r[1]) // 4 for r in rows), after(len(r[2]) // 4 for r in rows)
        self.a, self.b = (np.frombuffer(b"".join([r[k] for r in rows]), "<u4").astype(np.int64) for k in (1, 2))
        ends_a, ends_b = np.cumsum(tables.size_a[self.a]), np.cumsum(tables.size_b[self.b])
        # 1 where only an A token ends, 2 where only a B token does, 3 where both do
        count = np.bincount(np.concatenate([ends_a, ends_b, ends_b]), minlength=int(byte[-1]) + 1)
        ends = np.flatnonzero(count)
        which = count[ends]
        is_a, is_b, cut = which != 2, which != 1, which == 3
        # a link for each end: the token that ends there, or the one around it
        self.link_a, self.link_b = self.a[np.cumsum(is_a) - is_a], self.b[np.cumsum(is_b) - is_b]
        self.links = np.searchsorted(ends, byte, side="right")  # a document's links are links[k] to links[k + 1]
        # the group of each token, and whether the token is its side's last there
        cuts = np.cumsum(cut)
        self.last_a, self.last_b = cut[is_a], cut[is_b]
        self.group_a, self.group_b = cuts[is_a] - self.last_a, cuts[is_b] - self.last_b
        self.groups = np.concatenate([[0], cuts])[self.links]

    def n_groups(self) -> np.ndarray:
        return np.diff(self.groups)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """document (by place), pair and times: each document's distinct linked pairs of ids, in order of document."""
        document = np.repeat(np.arange(self.n), np.diff(self.links))
        every = np.sort(document << 2 * SHIFT | self.link_a << SHIFT | self.link_b)
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(every)), bool), every[1:] != every[:-1]]))
        return every[new] >> 2 * SHIFT, every[new] & (1 << 2 * SHIFT) - 1, np.diff(np.append(new, len(every)))

    def group_texts(self) -> list[bytes]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
        a_in, b_in = (np.bincount(g, minlength=int(self.groups[-1])) for g in (self.group_a, self.group_b))
        # a group's A tokens come before its B tokens, and both after all of earlier groups
        place_a = np.arange(len(self.a)) + (np.cumsum(b_in) - b_in)[self.group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(a_in)[self.group_b]
        entry = np.empty(len(self.a) + len(self.b), np.int64)
        entry[place_a] = 2 * self.a + self.last_a
        entry[place_b] = self.tables.first_b + 2 * self.b + self.last_b
        text = self.tables.digits[entry][self.tables.own[entry]].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.tables.digit_size[entry])])[self.at_a + self.at_b]
        return [text[p : q - 1] if q > p else b"" for p, q in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=1)
def load(path_a: str, path_b: str) -> Aligner:
    """A worker loads the vocabularies once."""
    return Aligner(path_a, path_b)


def parts(raws: list[bytes | None]):
    """Ranges of rows with no more than BATCH_BYTES of text in all, or one row."""
    at = 0
    while at < len(raws):
        end, total = at, 0
        while end < len(raws) and (end == at or total + len(raws[end] or b"") <= BATCH_BYTES):
            total += len(raws[end] or b"")
            end += 1
        yield at, end
        at = end


def lists(document: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """One list for each of n documents of values in order of document."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(document, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a and b (ids), groups (their text, null without tokens), n_groups, n_links, pairs (distinct linked pairs of ids, a << 20 | b) and times (links of each)."""
    return laid_out(docs, path_a, path_b, True)


def laid_out(docs: DataFrame, path_a: str, path_b: str, with_ids: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    if with_ids:
        shape = f"doc_id {kind}, a array<long>, b array<long>, groups string, n_groups long, n_links long, pairs array<long>, times array<long>"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tables, raws, out = load(path_a, path_b), batch.column(1).to_pylist(), []
        for at, end in parts(raws):
            rows = [tables.tokens(decoded(raw)) for raw in raws[at:end]]
            found = Aligned(tables, rows)
            document, pair, times = found.pairs()
            texts, n = found.group_texts(), end - at
            numbers = [pa.array(x, pa.int64()) for x in (found.n_groups(), np.diff(found.links))]
            held = [lists(document, pair, n), lists(document, times, n)]
            if with_ids:
                ids = [lists(np.repeat(np.arange(n), np.diff(place)), values, n) for place, values in ((found.at_a, found.a), (found.at_b, found.b))]
                own = [*ids, pa.array([t.decode() if t else None for t in texts], pa.string()), *numbers]
            else:
                sizes = [pa.array(np.diff(place), pa.int64()) for place in (found.at_a, found.at_b)]
                own = [*sizes, *numbers, pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string())]
            out.append(pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *own, *held], names=names))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    names = [field.split(" ")[0] for field in shape.split(", ")]
    return map_batches(docs.select("doc_id", text_bytes()), run, shape)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair and links, the number of links that hold it in all of rows(pairs, times)."""
    flat = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), "x.times")
    return flat.groupBy("pair").agg(F.sum("times").alias("links"))


def with_best(counted: DataFrame) -> DataFrame:
    """counted(pair, links) with best: 1 where no pair of its B id has more links, else 0."""
    b = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    highest = counted.groupBy(b.alias("b")).agg(F.max("links").alias("highest"))  # a row for each id of B's vocabulary at most
    return counted.withColumn("b", b).join(F.broadcast(highest), "b").select("pair", "links", (F.col("links") == F.col("highest")).cast("long").alias("best"))


def token_links(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of docs(doc_id, text)."""
    path = work_dir(docs.sparkSession, "alignment")
    # each row has a number; stored, so that it stays
    rows = stored(laid_out(docs, path_a, path_b, False).withColumn("row", F.monotonically_increasing_id()), f"{path}/rows")
    counted = stored(pair_counts(rows), f"{path}/counted")
    counts = with_best(counted)
    flat = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    if counted.count() <= broadcast_pairs:
        held = flat.join(F.broadcast(counts), "pair")
    else:
        parts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = flat.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(parts, ["pair", "salt"])
    sums = held.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
