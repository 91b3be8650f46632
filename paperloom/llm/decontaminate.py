"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words: positions marked 1 are hashed, positions marked 0 may hold
any word. Hashes of the test items' seeds meet those of the documents' seeds; each hit gives an alignment of
an item and a document, and around it the words are compared one by one. The alignment counts if some
stretch of at least ``min(MIN_WORDS, words of the item)`` words has ``PERCENT`` percent or more equal words.

No such stretch of MIN_WORDS words or more is missed. Every pattern of 13 to 25 words with a fifth of them
substituted leaves one of MASKS unbroken (a test goes through all), and a longer stretch has a half, of 13
words or more, that has as large a share of equal words. Shorter items are found whole in the same way, by
SHORT_MASKS: with one other word from five words on, with two from ten on. Words are runs of letters, marks and digits of any
script in lower case, parted by all else; in scripts written without spaces each character is a word. Invisible joiners and soft hyphens don't count.

Hashes are joined in one of two ways, with equal results. A benchmark of up to ``BLOCK_WORDS`` words is sent to all tasks (about 50 bytes a word), which
look each document's seeds up in it. Of a larger one the seeds are a table: documents are hashed once, whatever its size, a sieve of
fixed size drops most of their seeds, and the rest meet the table in a join dealt by hash, with the hashes of common phrases in ``SALTS`` parts. Each pair of a text and an
item found so is compared where the text and those items come together, ``BLOCK_WORDS`` words of items at a time. Equal texts are compared once.

Defined cases: null and wordless texts match nothing; a null id is carried; each repeated row has its own
results, and items of one id and different texts too; of several alignments of an item the longest stretch counts, then that with more
equal words, then the first; a text of any length is read whole, its hits HITS at a time; empty tables give no
rows; other columns are ignored or, in filtering, kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import any_names, bound_batches, decoded, map_rows, quoted, stored, text_bytes, unused, work_dir

#: Masks of weight 6.
MASKS = ("1101111", "111010011", "11100100011")
#: For items of 5 to 12 words. Masks of weight 4.
SHORT_MASKS = ("1111", "11011", "10111", "11101")
MIN_WORDS, PERCENT = 13, 80
BLOCK_WORDS = 500_000
#: Hits that are put together before equal ones are merged.
HITS = 1 << 18
#: Rows of texts found that may be sent to all tasks, about 60 MB; beyond that documents are shuffled by digest.
BROADCAST_TEXTS = 1_000_000
#: Bits of the table that most document seeds fail at.
SIEVE_BITS = 20
#: Bits of the sieve for a benchmark that is joined, 16 MB, and of each of its parts.
WIDE_SIEVE_BITS, PART_BITS = 27, 16
#: Parts that a hash's items are dealt in.
SALTS = 8
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
#: Non-ASCII characters that are no part of a word, or one of their own.
ODD = regex.compile(rf"[^\x00-\x7F\p{{L}}\p{{N}}\p{{M}}]|[{UNSPACED}]")
ALONE, INVISIBLE, APART = regex.compile(rf"[{UNSPACED}]\p{{M}}*"), regex.compile("[\u00ad\u200c\u200d\u2060\ufeff]"), regex.compile(r"[^\x00-\x7F\p{L}\p{N}\p{M}]+")
SEPARATORS = bytes.maketrans(bytes(range(128)), bytes(c if chr(c).isalnum() else 32 for c in range(128)))
STEP = np.uint64(0x9E3779B97F4A7C15)


def normal_words(raw: bytes | None) -> np.ndarray:
    """64-bit hashes of a text's words."""
    text = decoded(raw).lower()
    if not text.isascii() and ODD.search(text):
        text = APART.sub(" ", ALONE.sub(r" \g<0> ", INVISIBLE.sub("", text)))
    words = text.encode().translate(SEPARATORS).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash at each position where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out *= STEP
            out += words[k : k + n]
    out ^= out >> np.uint64(29)
    return out * STEP


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for an item of n words; one that may have no other word is one seed."""
    if 100 * (n - 1) < PERCENT * n:
        return ("1" * n,) if n else ()
    return MASKS if n >= MIN_WORDS else SHORT_MASKS


class Index:
    """The seeds of some test items."""

    def __init__(self, items: list[tuple[object, bytes | None]]):
        self.ids = [i for i, _ in items]
        self.words = [normal_words(x) for _, x in items]
        rows: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, words in enumerate(self.words):
            for mask in dict.fromkeys(masks_of(len(words))):
                found = seeds(words, mask)
                rows.setdefault(mask, []).append((found, np.full(len(found), k), np.arange(len(found))))
        self.tables = {}
        for mask, parts in rows.items():
            keys, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[keys >> np.uint64(64 - SIEVE_BITS)] = True
            self.tables[mask] = (sieve, keys[order], item[order], at[order])

    def hits(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(item, shift): the item's first word stands at that word of the document."""
        out = np.empty(0, np.int64)
        for mask, (sieve, keys, item, at) in self.tables.items():
            found = seeds(words, mask)
            where = np.flatnonzero(sieve[found >> np.uint64(64 - SIEVE_BITS)])
            if not len(where):
                continue
            first, last = np.searchsorted(keys, found[where], "left"), np.searchsorted(keys, found[where], "right")
            size = last - first
            where, first, size = where[size > 0], first[size > 0], size[size > 0]
            upto = np.cumsum(size)
            a = 0
            while a < len(size):  # some places at a time; one place has a block's seeds at most
                b = max(a + 1, int(np.searchsorted(upto, upto[a] - size[a] + HITS, "right")))
                some = size[a:b]
                place = np.repeat(first[a:b] - (np.cumsum(some) - some), some) + np.arange(some.sum())
                out = np.union1d(out, item[place] << 32 | (np.repeat(where[a:b], some) - at[place] + (1 << 31)))
                a = b
        return set(zip((out >> 32).tolist(), ((out & 0xFFFFFFFF) - (1 << 31)).tolist(), strict=True))

    def overlaps(self, words: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """For each item that the document holds: length of the best stretch, equal words in it, and its first word in the document."""
        best: dict[int, tuple[int, int, int]] = {}
        for item, shift in self.hits(words):
            own = self.words[item]
            start, end = max(0, -shift), min(len(own), len(words) - shift)
            equal = own[start:end] == words[shift + start : shift + end]
            if 100 * np.count_nonzero(equal) < PERCENT * min(MIN_WORDS, len(own)):
                continue
            stretch = longest_stretch(equal)
            if stretch and stretch[1] - stretch[0] >= min(MIN_WORDS, len(own)):
                a, b = stretch
                found = (b - a, int(equal[a:b].sum()), shift + start + a)
                # the longest; of equally long ones that with more equal words, then the first
                if item not in best or (found[0], found[1], -found[2]) > (best[item][0], best[item][1], -best[item][2]):
                    best[item] = found
        return best


def longest_stretch(equal: np.ndarray, percent: int = PERCENT) -> tuple[int, int] | None:
    """The longest stretch of which percent or more are true; the first of equally long ones."""
    if not len(equal):
        return None
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    # from each place to the last one whose sum is no lower
    last = np.maximum.accumulate(sums[::-1])[::-1]
    best, a, b, n = None, 0, 0, len(sums)
    while a < n:
        while b + 1 < n and last[b + 1] >= sums[a]:
            b += 1
        if b > a and (best is None or b - a > best[1] - best[0]):
            best = (a, b)
        a += 1
        b = max(a, b)
    return best


def benchmark_of(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """item_id and raw of the items, and in how many blocks of words they come."""
    items = benchmark.select("item_id", text_bytes().alias("raw"))
    # a word takes two bytes with its separator, or three as a character of its own
    total = items.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()[0] // 2
    return items, max(1, -(-total // block_words))


def index_of(items: DataFrame) -> Index:
    return Index([(r["item_id"], None if r["raw"] is None else bytes(r["raw"])) for r in items.collect()])  # one block


#: What is found of an item in a document, besides the item's length.
FOUND = "overlap_words long, equal_words long, first_word long"


def find_overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, item_words, overlap_words, equal_words and first_word for each document and item that it holds."""
    spark = docs.sparkSession
    bound_batches(spark)
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, item_words long, {FOUND}"
    names = [x.split()[0] for x in schema.split(", ")]
    items, blocks = benchmark_of(benchmark, block_words)
    if blocks > 1:
        found = joined_overlaps(docs.select(text_bytes()), items, blocks)
        held = docs.select("doc_id", digest_of(F.col("text")).alias("digest"))
        return held.join(small(found), "digest").select(*names)
    shared = spark.sparkContext.broadcast(index_of(items))

    def run(batches):
        own = shared.value
        for batch in batches:
            out = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(doc, own.ids[i], len(own.words[i]), *x) for i, x in sorted(own.overlaps(normal_words(raw)).items())]
            if out:
                columns = list(zip(*out, strict=True))
                types = [batch.schema.field(0).type, None, *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select("doc_id", text_bytes()).mapInArrow(run, schema)


def small(found: DataFrame) -> DataFrame:
    """Rows of texts that are sent to all tasks while there are few."""
    return F.broadcast(found) if found.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else found


def digest_of(text):
    """A text's digest as bytes; null for null."""
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def seeds_of(raw: bytes | None, masks: tuple[str, ...]) -> np.ndarray:
    """The distinct hashes of all masks' seeds, as signed longs."""
    words = normal_words(raw)
    return np.unique(np.concatenate([seeds(words, m) for m in masks] or [np.empty(0, np.uint64)])).view(np.int64)


def sieve_of(hashes: DataFrame) -> np.ndarray:
    """A bit for the upper bits of each hash. Parts of the sieve are put together in tasks."""
    top, low = F.shiftrightunsigned("hash", 64 - WIDE_SIEVE_BITS), F.lit((1 << PART_BITS) - 1).cast("long")
    marked = hashes.select(F.shiftright(top, PART_BITS).alias("part"), top.bitwiseAND(low).alias("bit")).distinct()

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PART_BITS, bool)
        bits[rows["bit"].to_numpy()] = True
        return pa.table({"part": [key[0].as_py()], "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros(1 << WIDE_SIEVE_BITS - 3, np.uint8)
    size = 1 << PART_BITS - 3
    for row in marked.groupBy("part").applyInArrow(pack, "part long, bits binary").toLocalIterator():  # 16 MB in all
        out[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def joined_overlaps(texts: DataFrame, items: DataFrame, blocks: int) -> DataFrame:
    """digest, item_id, item_words and FOUND of each different text of texts(text) and item that it holds, by a join of hashes."""
    spark = texts.sparkSession
    bound_batches(spark)
    path = work_dir(spark, "overlaps")
    # each item has a number; stored, so that it stays
    items = stored(items.withColumn("row", F.monotonically_increasing_id()), f"{path}/items")

    def hashed(batches):
        for batch in batches:
            found = [(masks := masks_of(len(normal_words(raw))), seeds_of(raw, masks)) for raw in batch.column(1).to_pylist()]
            lists = [pa.array([x for x, _ in found], pa.list_(pa.string())), pa.array([x for _, x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["row", "masks", "hashes"])

    held = stored(items.select("row", "raw").mapInArrow(hashed, "row long, masks array<string>, hashes array<long>"), f"{path}/item-seeds")
    masks = tuple(sorted(r[0] for r in held.select(F.explode("masks")).distinct().collect()))  # of the few there are
    item_seeds = held.select(F.explode("hashes").alias("hash"), "row")
    sieve = spark.sparkContext.broadcast(sieve_of(item_seeds.select("hash")))

    def sifted(batches):
        bits = sieve.value
        for batch in batches:
            digests, hashes = [], []
            for raw in batch.column(0).to_pylist():
                if raw:
                    every = seeds_of(raw, masks)
                    top = every.view(np.uint64) >> np.uint64(64 - WIDE_SIEVE_BITS)
                    some = every[bits[top >> np.uint64(3)] >> (7 - (top & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                    if len(some):
                        digests.append(hashlib.md5(raw).digest())
                        hashes.append(some)
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], names=["digest", "hashes"])

    of_texts = texts.mapInArrow(sifted, "digest binary, hashes array<long>").select("digest", F.explode("hashes").alias("hash")).distinct()
    salted = item_seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = of_texts.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"]).select("digest", "row").distinct()
    pairs = stored(pairs.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))), f"{path}/pairs")

    own = texts.withColumn("digest", digest_of(F.col("text"))).join(pairs.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    own = own.join(pairs.select("digest", "block").distinct(), "digest")
    kind = items.schema["item_id"].dataType.simpleString()

    def compare(key: tuple, rows: pa.Table, wanted: pa.Table) -> pa.Table:
        index = Index(list(zip(wanted["item_id"].to_pylist(), wanted["raw"].to_pylist(), strict=True)))
        found = sorted(index.overlaps(normal_words(rows["text"][0].as_py())).items()) if rows.num_rows else []
        columns = [[key[0].as_py()] * len(found), [index.ids[i] for i, _ in found], [len(index.words[i]) for i, _ in found], *([x[k] for _, x in found] for k in range(3))]
        types = [pa.binary(), wanted.schema.field("item_id").type, *[pa.int64()] * 4]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["digest", "item_id", "item_words", *(x.split()[0] for x in FOUND.split(", "))])

    candidates = pairs.join(items, "row").select("digest", "block", "item_id", "raw")
    found = own.groupBy("digest", "block").cogroup(candidates.groupBy("digest", "block")).applyInArrow(compare, f"digest binary, item_id {kind}, item_words long, {FOUND}")
    return stored(found, f"{path}/found")


@any_names("text")
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that hold no test item, with all their columns."""
    spark = docs.sparkSession
    bound_batches(spark)
    items, blocks = benchmark_of(benchmark, block_words)
    if blocks == 1:
        return _clean(docs, spark.sparkContext.broadcast(index_of(items)))
    key = unused(docs, "_digest")
    gone = joined_overlaps(docs.select(text_bytes()), items, blocks).select(F.col("digest").alias(key)).distinct()
    return docs.withColumn(key, digest_of(F.col("text"))).join(small(gone), key, "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])


def _clean(docs: DataFrame, shared) -> DataFrame:
    raw = docs.withColumn(unused(docs, "_raw"), text_bytes())  # the last column

    def run(batches):
        own = shared.value
        for batch in batches:
            good = [not own.overlaps(normal_words(x)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(good, pa.bool_()))

    return map_rows(raw, run, docs.schema)
