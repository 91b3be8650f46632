"""Length-delimited binary token records.

A file is a row of frames, one per sequence:

    8 bytes   length of the payload, little-endian
    4 bytes   masked checksum of these 8 bytes
    n bytes   payload
    4 bytes   masked checksum of the payload
    1 byte    0x0A, the frame's end mark

and a payload is: 1 byte flags (1: the sequence's id is null, 2: the tokens are a Zstandard frame), 8 bytes
id (signed), 1 byte bytes per token (2 or 4, by the vocabulary's size), then the tokens. All numbers are little-endian. A masked checksum is
CRC-32, turned right by 15 bits, plus a constant: so data that hold checksums don't check themselves.

Files follow each other in ascending order of id, and so do the frames in each. A separate offset index
(Parquet: doc_id, shard, offset, length, n_tokens) lets a reader fetch records in any order.

Spark's text sink writes the bytes: each frame is a row, the end mark is the sink's line end. So files
arrive whole through Spark's commit protocol in any store it can write, also when tasks are repeated.

Defined cases: a null text is an empty one and gives the end token alone; null ids come first; rows of one id
follow each other by a hash of their text, over as many files as they fill; repeated rows are each a record; a text
of any length is one record of one file, up to what a binary cell holds (2 GB); a damaged frame stops the read;
an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import bound_batches, decoded, stored, text_bytes, words_of, work_dir

#: Fixed values of the frame format.
MASK_ADD, MASK_TURN, END_MARK = 0xA282EAD8, 15, b"\n"
HEAD, HEAD_SIZE, LENGTH, CHECK = "<Bqb", 10, "<Q", "<I"
#: Bytes of text for one file. Tokens take about 1.3 times a text's bytes at worst in common text.
SHARD_TEXT_BYTES = 16 << 20
#: Words remembered in a worker, in each of two generations, and the longest that is.
MEMO_WORDS, MEMO_BYTES = 400_000, 64
#: Marks that are a piece of their own after a letter, and the bytes of characters below U+0300.
MARKS, BELOW_MARKS = (b".", b",", b";", b":", b"!", b"?"), bytes(range(0xCC))


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> MASK_TURN | crc << (32 - MASK_TURN)) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A frame without its end mark."""
    size = struct.pack(LENGTH, len(payload))
    return b"".join([size, struct.pack(CHECK, masked_crc(size)), payload, struct.pack(CHECK, masked_crc(payload))])


def read_frame(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the frame at an offset, and where the next one begins."""
    size = bytes(data[at : at + 8])
    if len(size) < 8 or struct.unpack_from(CHECK, data, at + 8)[0] != masked_crc(size):
        raise ValueError(f"damaged length at offset {at}")
    begin = at + 12
    end = begin + struct.unpack(LENGTH, size)[0]
    payload = data[begin:end]
    if end + 5 > len(data) or struct.unpack_from(CHECK, data, end)[0] != masked_crc(payload) or data[end + 4 : end + 5] != END_MARK:
        raise ValueError(f"damaged record at offset {at}")
    return payload, end + 5


class WordTokenizer:
    """A tokenizer whose words stand by themselves: white space is dropped, and no piece or normal form reaches over it.

    Each different word is encoded once and remembered. Before that, ASCII letters are lower-cased, as the
    tokenizer does itself, where no combining mark can follow them (no character from U+0300 on) and no
    special token is spelt. Letters alone are one piece, and a lone mark after them is one of its own, unless
    the last letter ends in a combining mark once it is in normal form and lower case: ``apart`` asks the model.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        names = self.model.get_vocab()
        self.width = 2 if len(names) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.ends = np.zeros(max(names.values()) + 1, bool)  # tokens that end a piece
        self.ends[[i for t, i in names.items() if t.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.long: list[bytes] = []  # learned in this batch, and forgotten after it
        self.marks = {m: self.whole([m])[0] for m in MARKS}
        self.after: dict[str, bool] = {}

    def whole(self, words: list[bytes]) -> list[bytes]:
        """The token bytes of words, each encoded by itself."""
        found = self.model.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def apart(self, letter: str) -> bool:
        """Whether each mark after this letter is a piece of its own."""
        found = self.after.get(letter)
        if found is None:
            raw = letter.encode()
            alone, *both = self.whole([raw, *(raw + m for m in MARKS)])
            found = self.after[letter] = both == [alone + self.marks[m] for m in MARKS]
        return found

    def letters(self, words: list[bytes]) -> list[bytes]:
        """The token bytes of words of letters alone: encoded as one text and parted after each piece."""
        out: list[bytes] = []
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            ids = np.array(self.model.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, self.kind)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            if len(cuts) != len(part):
                out += self.whole(part)
                continue
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *cuts], cuts)]
        return out

    def learn(self, words: set[bytes]) -> None:
        memo, older = self.memo, self.older
        self.long += [w for w in words if len(w) > MEMO_BYTES]
        old = {w for w in words if w in older}
        memo.update((w, older[w]) for w in old)
        marked, plain, other = [], set(), []
        for w in words - old:
            text = w.decode("utf-8", "replace")
            if text.isalpha():
                plain.add(w)
            elif w[-1:] in self.marks and text[:-1].isalpha() and self.apart(text[-2]):
                marked.append(w)
            else:
                other.append(w)
        stems = {w[:-1] for w in marked}
        self.long += [w for w in stems if len(w) > MEMO_BYTES]
        memo.update((w, older[w]) for w in stems if w in older and w not in memo)
        letters = list((plain | stems).difference(memo))
        memo.update(zip(letters, self.letters(letters), strict=True))
        memo.update((w, memo[w[:-1]] + self.marks[w[-1:]]) for w in marked)
        memo.update(zip(other, self.whole(other), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The token bytes of whole texts."""
        split = [words_of(x if x.translate(None, BELOW_MARKS) or b"<|" in x else x.lower()) for x in texts]
        if len(self.memo) >= MEMO_WORDS:
            self.older, self.memo = self.memo, {}
        out: list[bytes] = []
        for words in split:
            self.learn(set(words).difference(self.memo))
            out.append(b"".join(map(self.memo.__getitem__, words)))
        for w in self.long:
            self.memo.pop(w, None)
        self.long.clear()
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def payload_of(doc_id: int | None, tokens: bytes, width: int, compressor) -> bytes:
    small = compressor.compress(tokens)
    packed = len(small) < len(tokens)
    return struct.pack(HEAD, (doc_id is None) + 2 * packed, doc_id or 0, width) + (small if packed else tokens)


def tokens_of(payload: memoryview, expander) -> tuple[int | None, np.ndarray]:
    """The id and tokens of a payload."""
    flags, doc_id, width = struct.unpack_from(HEAD, payload)
    raw = payload[HEAD_SIZE:]
    return None if flags & 1 else doc_id, np.frombuffer(expander.decompress(raw) if flags & 2 else raw, f"<u{width}")


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_text_bytes: int = SHARD_TEXT_BYTES) -> None:
    """Encode docs(doc_id, text), append end_id to each, and write record files in ascending doc_id order.

    Texts, which compress better than ids, are dealt by ranges of doc_id, those of one id by a hash of the text, and
    sorted in each task; tokens go straight to the file.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    total = docs.select(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    order = F.asc_nulls_first("doc_id"), F.xxhash64("text")
    ordered = rows.repartitionByRange(int(max(1, -(-total // shard_text_bytes))), *order).sortWithinPartitions(*order)

    def run(batches):
        encoder, compressor = load(tokenizer), zstandard.ZstdCompressor(level=1)
        last = encoder.kind.type(end_id).tobytes()
        for batch in batches:
            tokens = encoder.encode([x or b"" for x in batch.column(1).to_pylist()])
            frames = [frame(payload_of(i, t + last, encoder.width, compressor)) for i, t in zip(batch.column(0).to_pylist(), tokens, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """shard, offset, length, doc_id, before (tokens before it in its shard), n_tokens and ids_crc32 of each record.

    ids_crc32 is over the tokens as little-endian unsigned 32-bit integers. A task holds one file at a time.
    """
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    schema = "shard string, offset long, length long, doc_id long, before long, n_tokens long, ids_crc32 long"

    def run(batches):
        expander = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data, at, before, rows = memoryview(content.as_buffer()), 0, 0, []
                while at < len(data):
                    payload, end = read_frame(data, at)
                    doc_id, ids = tokens_of(payload, expander)
                    rows.append((name.as_py(), at, end - at, doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                    at = end
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), *[pa.int64()] * 6], strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content").mapInArrow(run, schema)


def write_index(records: DataFrame, path: str) -> DataFrame:
    """Store the offset index of records, with each record's place among all tokens (start), and return it.

    Shards follow each other by the part number in their name, which Spark pads to five digits only. Only shards are put in order in one task, one row for each file.
    """
    sums = records.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    part = F.regexp_extract("shard", r"^part-(\d+)", 1).try_cast("long")
    first = sums.select("shard", (F.sum("tokens").over(Window.orderBy(part, F.length("shard"), "shard")) - F.col("tokens")).alias("first"))
    placed = records.join(first, "shard").withColumn("start", F.col("first") + F.col("before")).drop("first", "before")
    return stored(placed, path)


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, offset and length of each record, read back from its files."""
    spark = docs.sparkSession
    path = work_dir(spark, "records")
    write_records(docs, f"{path}/data", tokenizer, end_id)
    # the index without start is stored first: the files are parsed once
    found = stored(read_records(spark, f"{path}/data"), f"{path}/found")
    return write_index(found, f"{path}/index").select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "length")


def fetch(index: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<long>) of the records in index(shard, offset, doc_id): a shuffled read by offset."""
    spark = index.sparkSession
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    wanted = index.groupBy("shard").agg(F.collect_list("offset").alias("offsets"))  # no more than one file's records
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content").join(wanted, "shard").select("content", "offsets")

    def run(batches):
        expander = zstandard.ZstdDecompressor()
        for batch in batches:
            for content, offsets in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data, ids, out = memoryview(content.as_buffer()), [], []
                for at in offsets:
                    payload, _ = read_frame(data, at)
                    doc_id, found = tokens_of(payload, expander)
                    ids.append(doc_id)
                    out.append(found.astype(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids array<long>")
