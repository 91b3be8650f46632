"""Source divergence audit: how the sources of a language differ from each other and from the language as a whole.

Terms are runs of letters A-Z (lower-cased) and non-ASCII characters. A language keeps its V terms that stand in
MIN_DOCS documents or more. A source of a language (a group), and the language itself, gives each kept term the smoothed share
p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)), N being its occurrences of kept terms. Two shares p and q
differ by f = floor((p - q)**2 / (p + q)). All arithmetic is in whole numbers.

1. Tasks count terms by group as they read, and hand over their counts whenever they hold FLUSH of them; Spark adds them up.
2. A language's kept terms are dealt in blocks by a hash, so many that a block's dense int64 tile, groups by terms,
   has about CELLS cells. Blocks of one language lie in different tasks.
3. A block's tile is compared row by row: one group's shares against those of all later groups, by broadcasting.
   That gives a partial matrix of pairs, whose rows are added up in Spark. The tile's sum over groups gives the language's shares, and
   each group keeps its TOP most overweight terms of the block; these short lists are merged.

A language with G groups has G * (G - 1) rows of pairs by definition; a task makes SLICE rows of the matrix, so where there
are more groups a tile is built by several tasks.

Defined cases: null texts, languages and sources are ''; a group without kept terms has shares all the same; without kept terms a
language's pairs have value 0; words of any length are whole terms; malformed UTF-8 becomes U+FFFD first; repeated rows count
each; ties go by the item's UTF-8 bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import bound_batches, decoded, stored, text_bytes, work_dir

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Counts that a task holds before it hands them over.
FLUSH = 200_000
#: Cells of a tile, 8 bytes each, and the fewest and most terms in a block.
CELLS, LEAST_TERMS, MOST_TERMS = 1 << 20, 64, 1 << 11
#: Sources that one task compares with all others, on average.
SLICE = 256
#: Bytes that part terms become spaces, A-Z become a-z.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(TABLE).split()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents) of every term, added up; and a row with the term '' for every group."""
    names = ["lang", "source", "term", "n", "df"]

    def rows(n: dict[tuple[str, str], Counter], df: dict[tuple[str, str], Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in n.items():
            size = len(terms) + 1
            columns = [pa.array([x] * size, pa.string()) for x in (lang, source)]
            columns.append(pa.array(["", *(t.decode() for t in terms)], pa.string()))
            columns += [pa.array([0, *x], pa.int64()) for x in (terms.values(), map(df[lang, source].__getitem__, terms))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        df: dict[tuple[str, str], Counter] = {}
        held = 0
        for batch in batches:
            for lang, source, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                key = decoded(lang), decoded(source)
                own = Counter(terms_of(decoded(raw).encode()))
                total = n.setdefault(key, Counter())
                held -= len(total)
                total.update(own)
                held += len(total)
                df.setdefault(key, Counter()).update(own.keys())
                if held >= FLUSH:
                    yield from rows(n, df)
                    n, df, held = {}, {}, 0
        yield from rows(n, df)

    bound_batches(docs.sparkSession)
    read = docs.select(text_bytes("lang"), text_bytes("source"), text_bytes()).mapInArrow(run, "lang string, source string, term string, n long, df long")
    return read.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), total being N + 2 * V, digit by digit so that no product passes 64 bits."""
    rest, out = count + 2, np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Tile:
    """A block of one language: its sources and terms, each in order of their UTF-8 bytes, counts n (sources by terms) and shares p of the sources and q of the language."""

    def __init__(self, cells: pa.Table, groups: pa.Table):
        groups = groups.sort_by("source")
        self.sources, self.terms = groups["source"].combine_chunks(), cells["term"].combine_chunks().unique().sort()
        doubled = 2 * groups["v"].to_numpy()
        self.n = np.zeros((len(self.sources), len(self.terms)), np.int64)
        self.n[pc.index_in(cells["source"], self.sources).to_numpy(), pc.index_in(cells["term"], self.terms).to_numpy()] = cells["n"].to_numpy()
        self.p = shares(self.n, (groups["total"].to_numpy() + doubled)[:, None])
        self.q = shares(self.n.sum(0), (groups["of_lang"].to_numpy() + doubled)[:1])

    def pairs(self, g: int) -> np.ndarray:
        """How far the g-th source is from each later one, over the block's terms."""
        return apart(self.p[g], self.p[g + 1 :]).sum(1)

    def overweight(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """The g-th source's TOP terms of a larger share than the language's, and how far they are from it."""
        some = np.flatnonzero((self.n[g] > 0) & (self.p[g] > self.q))
        far = apart(self.p[g, some], self.q[some])
        best = np.argsort(-far, kind="stable")[:TOP]
        return some[best], far[best]


def compared(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """part, lang, source, item and value of a block: its pairs of sources, each once, and its share of each source's top terms."""
    tile, lang, out = Tile(cells, groups), key[0].as_py(), []
    own = set(pc.index_in(groups.filter(pc.field("mine"))["source"], tile.sources).to_pylist())
    for g in sorted(own):
        terms, far = tile.overweight(g)
        for part, items, values in (("pair", tile.sources[g + 1 :], tile.pairs(g)), ("term", tile.terms.take(pa.array(terms)), far)):
            n = len(items)
            out.append(pa.table([pa.repeat(part, n), pa.repeat(lang, n), pa.repeat(tile.sources[g], n), items, pa.array(values, pa.int64())], schema=SHAPE))
    return pa.concat_tables(out) if out else SHAPE.empty_table()


SHAPE = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank for docs(text, lang, source)."""
    path = work_dir(docs.sparkSession, "divergence")
    counts = stored(counted(docs), f"{path}/counts")
    terms = counts.filter("term != ''")
    kept = stored(terms.groupBy("lang", "term").agg(F.sum("df").alias("df")).filter(F.col("df") >= MIN_DOCS).select("lang", "term"), f"{path}/kept")
    cells = stored(terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), f"{path}/cells")
    groups = stored(counts.filter("term = ''").select("lang", "source").join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, ["total"]), f"{path}/groups")
    of_lang = groups.groupBy("lang").agg(F.count("*").alias("g"), F.sum("total").alias("of_lang")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").fillna(0, ["v"])
    width = F.least(F.greatest(F.floor(CELLS / F.col("g")), F.lit(LEAST_TERMS)), F.lit(MOST_TERMS))
    sized = of_lang.withColumns({"blocks": F.greatest(F.ceil(F.col("v") / width), F.lit(1)), "slices": F.ceil(F.col("g") / F.lit(SLICE))})
    sized = stored(sized.select("lang", "of_lang", "v", "blocks", "slices"), f"{path}/langs")

    # a block's tile is built once for each slice of its sources, which are compared with all later ones
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    dealt = cells.join(sized, "lang").select("lang", block.alias("block"), each("slices").alias("slice"), "source", "term", "n")
    mine = F.pmod(F.xxhash64("source"), F.col("slices")) == F.col("slice")
    sides = groups.join(sized, "lang").withColumn("block", each("blocks")).withColumn("slice", each("slices"))
    sides = sides.select("lang", "block", "slice", "source", "total", "of_lang", "v", mine.alias("mine"))
    at = ["lang", "block", "slice"]
    found = dealt.groupBy(*at).cogroup(sides.groupBy(*at)).applyInArrow(compared, "part string, lang string, source string, item string, value long")
    found = stored(found, f"{path}/found")

    once = found.filter("part = 'pair'").groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value"))
    both = once.unionByName(once.select("part", "lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = both.unionByName(found.filter("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")
