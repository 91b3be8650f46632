"""Near duplicates by b-bit MinHash, confirmed on full shingle sets.

1. One pass makes each text's set of word shingles, a 128-bit digest of the set, the hashes of bands of
   minima, and a signature that keeps the low ``BITS`` bits of each minimum, packed into longs.
2. Texts with equal digests are one node.
3. Nodes that share a band are candidates. In a bucket, each member is compared with one centre, the node
   that meets the most others over all its buckets: for copies of one text that is the text or what is
   nearest to it, so nearly all links are found with as many pairs as members. Linked nodes become
   components. Of buckets that then still hold several components, small ones (up to SMALL_BUCKET members) have
   all pairs between components looked at, each in the first band that it shares. In larger ones, where many texts just below the similarity
   meet, two nodes are compared only if they share one of their rarest shingles, at places that leave room for the similarity (see
   ``prefix_pairs``). Pages of one template with a few words of their own have none in common, and make no pair. The pairs of a shingle are counted
   first: where they are many for each node, more than far bands in all, these nodes are banded anew instead, by
   FAR_BANDS bands of FAR_ROWS further minima, in which texts meet that are much alike only: pairs of similarity a third, as of forms
   with the same questions and other answers, share none with a probability of 0.9997. Buckets of these bands are looked at in the same two ways.
4. A pair is compared by size, then by the similarity that the signatures' equal bits give, corrected for
   chance collisions, and at last by the full sets: 100 * intersection >= percent * union.

So each pair that could be similar enough is either compared or already inside one component, and none is made within
a component. What remains can be many only where many texts come close to the similarity by rare shingles too, or all shingles
of many such texts are common.
A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, below 1e-6, and no far band with
(1 - 0.8 ** FAR_ROWS) ** FAR_BANDS, below 1e-6; the estimate of such a pair, which deviates by 0.0217, falls under ESTIMATE with
probability below 3e-6. A linked pair is lost with 5e-6 in all, and only if no other way links the two.

Defined cases: null and wordless texts have an empty set and are linked with nothing; a text with fewer
words than a shingle has its whole sequence as the one shingle; repeated rows and equal ids each give a
row; a null id joins components like any other but never names one, and where a component has no other id
its id is null; a row is kept where its id equals the component's (null equals null); a text of any length is read
whole, in memory that grows with its words; an empty table gives no rows; other columns are ignored or, in filtering, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import any_names, bound_batches, map_batches, quoted, stored, text_bytes, unused, work_dir
from paperloom.llm.components import LOCAL_LINKS, components

ROWS, BANDS = 5, 36
#: Bands for nodes whose rarest shingles are common, of minima of their own.
FAR_ROWS, FAR_BANDS = 12, 200
#: Minima in the signature, of which the first ROWS * BANDS make the bands, and bits kept of each.
HASHES, BITS = 360, 4
LANES = 64 // BITS
LONGS = -(-HASHES // LANES)
#: Pairs whose estimated similarity is lower are not compared on full sets.
ESTIMATE = 0.7
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Buckets of so many members have all pairs between components looked at, 8 a member at most; larger ones are split.
SMALL_BUCKET = 16
#: Pairs for each member that a shingle may always make.
CHEAP_PAIRS = 8
#: Rows of ids and hashes that may be sent to all tasks, 50 MB at most; they are counted first.
BROADCAST_ROWS = 500_000
#: Parts that a large component is dealt in.
SALTS = 16
#: Classes of size for each factor of e.
SIZE_CLASSES = 32
#: Shingles whose minima are taken at a time, to stay in the processor's cache.
CHUNK = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def odd_multipliers(n: int, seed: int = 20240607) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def shingle_set(raw: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z is lower-cased, words part at ASCII white space."""
    words = (raw or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    step = np.uint64(0x9E3779B97F4A7C15)
    width = min(size, n)
    out = hashes[: n - width + 1].copy()
    for k in range(1, width):
        out *= step
        out += hashes[k : n - width + 1 + k]
    return np.unique(mixed(out + np.uint64(width)))


def minima(sets: list[np.ndarray], hashes: int = HASHES, seed: int = 20240607) -> np.ndarray:
    """So many minima of each set; none may be empty."""
    factors = odd_multipliers(hashes, seed)
    out = np.empty((hashes, len(sets)), np.uint64)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= CHUNK):
            total += len(sets[end])
            end += 1
        values = np.concatenate(sets[at:end])
        starts = np.concatenate([[0], np.cumsum([len(x) for x in sets[at : end - 1]])]).astype(np.int64)
        product = np.empty_like(values)
        for k, f in enumerate(factors):
            np.multiply(values, f, out=product)
            out[k, at:end] = np.minimum.reduceat(product, starts)
        at = end
    return out.T


def bands_of(least: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash of each band's minima and its number, as signed longs."""
    parts = least[:, : bands * rows].reshape(len(least), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(least), bands)).copy()
    for k in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum, LANES to a long; they are mixed first, as a product's own low bits hardly vary."""
    low = np.zeros((len(least), LONGS * LANES), np.uint64)
    low[:, :HASHES] = mixed(least) & np.uint64(2**BITS - 1)
    shift = np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(-1, LONGS, LANES) << shift, axis=2).view(np.int64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, n_shingles, digest (null for an empty set), bands and sig of each row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, shingle) for x in batch.column(1).to_pylist()]
        full = [x for x in sets if len(x)]
        least = minima(full) if full else np.empty((0, HASHES), np.uint64)
        lists = lambda rows: pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.int64()))
        where = pa.array(np.where([len(x) > 0 for x in sets], np.cumsum([len(x) > 0 for x in sets]) - 1, 0), mask=np.array([len(x) == 0 for x in sets]))
        take = lambda a: a.take(where) if full else pa.nulls(len(sets), a.type)
        digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([len(x) for x in sets], pa.int64()), digests, take(lists(bands_of(least))), take(lists(packed(least)))],
            names=["doc_id", "text_key", "n_shingles", "digest", "bands", "sig"],
        )

    return map_batches(docs.select("doc_id", text_bytes(), F.xxhash64("text").alias("text_key")), run, f"doc_id {kind}, text_key long, n_shingles long, digest binary, bands array<long>, sig array<long>")


def estimate(a: str, b: str):
    """The similarity that two packed signatures show: equal lanes, less those equal by chance, as a Column of the columns' names."""
    lanes = int(("0" * (BITS - 1) + "1") * LANES, 2)
    differ = None
    for k in range(LONGS):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        for step in (1, 2, 4, 8):
            if step < BITS:
                x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        one = F.bit_count(x.bitwiseAND(F.lit(lanes)))
        differ = one if differ is None else differ + one
    chance = 2.0**-BITS
    return ((1 - differ / F.lit(float(HASHES))) - chance) / (1 - chance)


def plausible(percent: int):
    """Whether sizes n_a, n_b and signatures sig_a, sig_b allow the similarity."""
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (estimate("sig_a", "sig_b") >= ESTIMATE)


def node_texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int, path: str) -> DataFrame:
    """node and text of the nodes in wanted(node), each once.

    A node's text is found by the id and the text's hash together, so many texts under one id, or without one, don't meet each other.
    """
    wanted = stored(wanted.distinct().join(nodes.select("node", "digest", "doc_min", "key_min"), "node"), f"{path}/wanted")
    size = wanted.count()
    side = F.broadcast(wanted) if size <= BROADCAST_ROWS else wanted  # texts are shuffled only beyond that
    held = docs.select(F.col("doc_id").alias("_id"), text_bytes(), F.xxhash64("text").alias("_key"))
    rows = held.join(side, F.col("_id").eqNullSafe(F.col("doc_min")) & (F.col("_key") == F.col("key_min"))).select("node", "digest", "text")

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Of several texts under one id and hash, the node's own."""
        same = [xxhash.xxh3_128_digest(shingle_set(x, shingle).tobytes()) == d for x, d in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        return batch.filter(pa.array(same, pa.bool_())).select(["node", "text"])

    texts = stored(map_batches(rows, own, "node long, text binary"), f"{path}/texts")
    if texts.count() > size:  # repeated rows
        texts = stored(texts.groupBy("node").agg(F.first("text").alias("text")), f"{path}/texts-once")
    return texts


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, path: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Only texts of nodes in pairs are fetched."""
    texts = node_texts(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), shingle, path)
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def compare(batches):
        last, of_last = None, None
        for batch in batches:
            good = []
            for a, text_a, text_b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if a != last:
                    last, of_last = a, shingle_set(text_a, shingle)
                other = shingle_set(text_b, shingle)
                same = len(np.intersect1d(of_last, other, assume_unique=True))
                good.append(100 * same >= percent * (len(of_last) + len(other) - same))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def linked_nodes(docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, path: str, local_links: int) -> DataFrame:
    """node and label of the nodes that are linked with others."""
    flat = nodes.select(F.posexplode("bands").alias("band", "key"), "node")
    shared = flat.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    members = stored(flat.join(shared, "key").select("key", "band", "node", "c"), f"{path}/members")
    meets = members.groupBy("node").agg(F.sum(F.col("c") - 1).alias("meets"))
    centres = members.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node")).alias("top")).select("key", F.col("top.node").alias("centre"))
    pairs = members.join(centres, "key").filter("node != centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    for end in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("sig").alias(f"sig_{end}")), end)
    tried = stored(pairs.filter(plausible(percent)).select("a", "b"), f"{path}/pairs-0")
    links = stored(confirmed(tried, docs, nodes, shingle, percent, f"{path}/confirm-0"), f"{path}/links-0")
    labels = stored(components(links, f"{path}/components-0", local_links), f"{path}/labels-0")

    rest = stored(between_components(docs, members, labels, nodes, shingle, percent, path).join(tried, ["a", "b"], "left_anti"), f"{path}/pairs-1")
    more = confirmed(rest, docs, nodes, shingle, percent, f"{path}/confirm-1")
    return components(stored(links.union(more), f"{path}/links-1"), f"{path}/components-1", local_links)


def between_components(docs: DataFrame, members: DataFrame, labels: DataFrame, nodes: DataFrame, shingle: int, percent: int, path: str) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket, lie in different components and may be similar enough; all that are."""
    named = members.select("key", "band", "node", "c").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    left = stored(named.join(several, "key"), f"{path}/left")
    own = lambda end, extra=(): nodes.select(F.col("node").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("sig").alias(f"sig_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in extra])

    few = left.filter(F.col("c") <= SMALL_BUCKET).select("key", "band", "node", "label")
    x, y = (few.select("key", "band", F.col("node").alias(end), F.col("label").alias(f"label_{end}")) for end in "ab")
    near = x.join(y.drop("band"), "key").filter("a < b and label_a != label_b").join(own("a", ["bands"]), "a").join(own("b", ["bands"]), "b")
    first_band = F.array_position(F.zip_with("bands_a", "bands_b", lambda p, q: p == q), True) - 1
    near = near.filter(plausible(percent) & (first_band == F.col("band"))).select("a", "b")

    crowd = stored(left.filter(F.col("c") > SMALL_BUCKET).select("node", "label").distinct(), f"{path}/crowd")
    if crowd.limit(1).count():
        far = crowd_pairs(shingles_of(docs, nodes, crowd, shingle, path), percent, path)
        near = near.union(far.join(own("a"), "a").join(own("b"), "b").filter(plausible(percent)).select("a", "b"))
    return near.distinct()


def crowd_pairs(sets: DataFrame, percent: int, path: str) -> DataFrame:
    """Pairs (a, b) of sets(node, label, n, shingles), a stored table, that differ in label and may reach the similarity; those of crowded shingles, if they also share a far band.

    The pairs of each shingle are counted first. Those that make more than CHEAP_PAIRS for each member are crowded; where they make more pairs in all than
    the far bands of their nodes make rows, these nodes are banded, so the work is of the order of the postings and nodes, not of the pairs.
    """
    x, y = prefix_postings(sets, percent, path)
    count = lambda rows, name: rows.groupBy(*PLACE).agg(F.count("*").alias(name))
    made = count(x, "of_x").join(count(y, "of_y"), PLACE).withColumn("pairs", F.col("of_x") * F.col("of_y"))
    dear = stored(made.filter(F.col("pairs") > CHEAP_PAIRS * (F.col("of_x") + F.col("of_y"))), f"{path}/dear")
    total = dear.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    if total:
        nodes = stored(x.select(*PLACE, F.col("node_x").alias("node")).union(y.select(*PLACE, "node_y")).join(dear, PLACE, "left_semi").select("node").distinct(), f"{path}/dear-nodes")
        if total > FAR_BANDS * nodes.count():
            far = far_pairs(far_bands(sets.join(nodes, "node")), percent, path)
            return stored(met(x.join(dear, PLACE, "left_anti"), y, percent).union(far).distinct(), f"{path}/far-pairs")
    return stored(met(x, y, percent), f"{path}/far-pairs")


def far_bands(sets: DataFrame) -> DataFrame:
    """sets(node, label, n, shingles) with far, the keys of the far bands."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [np.array(x, np.int64).view(np.uint64) for x in batch.column(3).to_pylist()]
        far = bands_of(minima(lists, FAR_ROWS * FAR_BANDS, 20240608), FAR_BANDS, FAR_ROWS) if lists else []
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(far), pa.list_(pa.int64()))], names=["node", "label", "n", "shingles", "far"])

    return map_batches(sets.select("node", "label", "n", "shingles"), run, "node long, label long, n long, shingles array<long>, far array<long>")


def far_pairs(sets: DataFrame, percent: int, path: str) -> DataFrame:
    """Pairs (a, b) of sets(node, label, n, shingles, far) that differ in label, share a far band and may reach the similarity."""
    sets = stored(sets, f"{path}/far-bands")
    flat = sets.select(F.explode("far").alias("bucket"), "node", "label")
    sizes = flat.groupBy("bucket").agg(F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket", "c")
    held = stored(flat.join(sizes, "bucket"), f"{path}/far-members")
    few = held.filter(F.col("c") <= SMALL_BUCKET)
    x, y = (few.select("bucket", F.col("node").alias(end), F.col("label").alias(f"label_{end}")) for end in "ab")
    pairs = x.join(y, "bucket").filter("a < b and label_a != label_b").select("a", "b").distinct()
    many = stored(held.filter(F.col("c") > SMALL_BUCKET).select("node").distinct(), f"{path}/far-crowd")
    if many.limit(1).count():
        close = stored(sets.drop("far").join(many, "node"), f"{path}/far-sets")
        pairs = pairs.union(prefix_pairs(close, percent, f"{path}/far-prefixes"))
    return pairs


def shingles_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int, path: str) -> DataFrame:
    """node, label, n and shingles (hashes) of the nodes in wanted(node, label)."""
    texts = node_texts(docs, nodes, wanted.select("node"), shingle, f"{path}/crowd-texts")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, shingle) for x in batch.column(1).to_pylist()]
        lists = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), lists], names=["node", "n", "shingles"])

    found = map_batches(texts, run, "node long, n long, shingles array<long>")
    return stored(found.join(wanted, "node"), f"{path}/crowd-shingles")


#: What the postings of prefixes are joined by.
PLACE = ["s", "size", "side"]


def prefix_pairs(sets: DataFrame, percent: int, path: str) -> DataFrame:
    """Pairs (a, b) of sets(node, label, n, shingles), a stored table, that differ in label and may reach the similarity."""
    return stored(met(*prefix_postings(sets, percent, path), percent), f"{path}/prefix-pairs")


def prefix_postings(sets: DataFrame, percent: int, path: str) -> tuple[DataFrame, DataFrame]:
    """What looks (s, size, side, node_x, ...) and what is looked up (s, size, side, node_y, ...), two stored tables.

    Shingles are ordered: first those of one label only, then the rarest. Two sets that have overlap o in
    common have the first common shingle at places i and j with n - i >= o on both sides, and o is at least
    percent / (100 + percent) of both sizes' sum. So only the first places of each set are looked up, the
    larger set looks for the smaller one, and classes of size bound its places before the join. Shingles
    of one label are never looked up, and for each key the label with the most sets never meets itself, so what
    the join goes through is of the order of what it gives.
    """
    p, q = percent, 100 + percent
    flat = sets.select(F.explode("shingles").alias("s"), "node", "label")
    shared = flat.groupBy("s").agg(F.count("*").alias("df"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("s", "df")
    found = flat.select("s", "node").join(stored(shared, f"{path}/shared"), "s").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("held"))  # one text's shingles
    places = found.join(sets.select("node", "label", "n"), "node").withColumn("alone", F.col("n") - F.size("held"))
    reach = F.greatest(F.lit(0), F.col("n") - F.ceil(p * F.col("n") / 100) + 1 - F.col("alone")).cast("int")
    posted = places.select("node", "label", "n", "alone", F.posexplode(F.slice("held", 1, reach)).alias("k", "x")).select("node", "label", "n", F.col("x.s").alias("s"), (F.col("alone") + F.col("k")).alias("at"))
    posted = stored(posted, f"{path}/posted")
    several = posted.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("s")
    posted = posted.join(several, "s")

    size_class = lambda n: F.floor(F.log(n.cast("double")) * SIZE_CLASSES).cast("int")
    least = F.ceil(p * F.col("n") / 100)
    kept = posted.filter(q * (F.col("n") - F.col("at")) >= 2 * p * F.col("n")).withColumn("size", size_class(F.col("n")))
    sought = posted.withColumn("size", F.explode(F.sequence(size_class(least), size_class(F.col("n")))))
    smallest = F.greatest(least, F.floor(F.exp(F.col("size") / SIZE_CLASSES)) - 1)
    sought = sought.filter(q * (F.col("n") - F.col("at")) >= p * (F.col("n") + smallest))
    crowds = kept.groupBy("s", "size", "label").agg(F.count("*").alias("sets")).groupBy("s", "size").agg(F.max(F.struct("sets", "label"))["label"].alias("most"))
    crowds = stored(crowds, f"{path}/crowds")
    kept = kept.join(crowds, ["s", "size"]).withColumn("side", (F.col("label") == F.col("most")).cast("int"))
    sought = sought.join(crowds, ["s", "size"]).withColumn("side", F.explode(F.when(F.col("label") == F.col("most"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    x = sought.select("s", "size", "side", *[F.col(c).alias(f"{c}_x") for c in ("node", "label", "n", "at")])
    y = kept.select("s", "size", "side", *[F.col(c).alias(f"{c}_y") for c in ("node", "label", "n", "at")])
    return stored(x, f"{path}/sought"), stored(y, f"{path}/kept")


def met(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of prefix_postings that leave room for the similarity."""
    p, q = percent, 100 + percent
    smaller = (F.col("n_y") < F.col("n_x")) | ((F.col("n_y") == F.col("n_x")) & (F.col("node_y") < F.col("node_x")))
    enough = q * F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= p * (F.col("n_x") + F.col("n_y"))
    pairs = x.join(y, PLACE).filter((F.col("label_x") != F.col("label_y")) & smaller & enough)
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def classes(docs: DataFrame, shingle: int, percent: int, local_links: int = LOCAL_LINKS) -> DataFrame:
    """doc_id, text_key, n_shingles, digest, label (a number of the component, null for an empty set) and component_id of each row of docs(doc_id, text)."""
    path = work_dir(docs.sparkSession, "minhash")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    marked = stored(signatures(docs, shingle), f"{path}/signatures")
    # a number for each different set; stored, so that it stays
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    nodes = marked.filter("digest is not null").groupBy("digest").agg(
        lowest.alias("lowest"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
    )
    nodes = nodes.withColumns({"doc_min": F.col("lowest.doc_id"), "key_min": F.col("lowest.text_key"), "node": F.monotonically_increasing_id()}).drop("lowest")
    nodes = stored(nodes, f"{path}/nodes")
    labels = stored(linked_nodes(docs, nodes, shingle, percent, path, local_links), f"{path}/labels")
    named = nodes.select("digest", "doc_min", "node").join(labels, "node", "left")
    # only linked nodes have a label; of a large component each task sends one row, and salt parts it in the join
    least = named.filter("label is not null").groupBy("label").agg(F.min("doc_min").alias("component_id"))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    parts = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = named.filter("label is not null").withColumn("salt", salt).join(parts, ["label", "salt"]).select("digest", "label", "component_id")
    named = linked.union(named.filter("label is null").select("digest", F.col("node").alias("label"), F.col("doc_min").alias("component_id")))
    found = marked.select("doc_id", "text_key", "n_shingles", "digest").join(named, "digest", "left")
    return found.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, local_links: int = LOCAL_LINKS) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, digest, component_id and kept for each row of docs(doc_id, text)."""
    found = classes(docs, shingle, percent, local_links)
    return found.select("doc_id", "text_key", "n_shingles", "digest", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@any_names("doc_id", "text")
def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: one row of each component, with all its columns.

    It is the one with the lowest id (null last), then the lowest hash of the text; of repeated rows any one. Rows
    without words are linked with nothing and all stay. Rows are found again by id and a hash of the text, as ids may be null or repeated.
    """
    path = work_dir(docs.sparkSession, "keep-one")
    names = docs.columns
    found = stored(classes(docs.select("doc_id", "text"), shingle, percent).filter("digest is not null").select("doc_id", "text_key", "label"), f"{path}/found")
    key, id_, hash_ = (unused(docs, c) for c in ("_key", "_id", "_hash"))
    held = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    # of a large component each task sends one row; its members never meet, each is looked up by its own id and hash
    best = found.groupBy("label").agg(F.min(rank).alias("best")).select("best.doc_id", "best.text_key")
    rows = stored(found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")), f"{path}/rows")
    gone = rows.join(best, rows["doc_id"].eqNullSafe(best["doc_id"]) & (rows["text_key"] == best["text_key"]), "left_anti").select(F.col("doc_id").alias(id_), F.col("text_key").alias(hash_))
    twice = rows.filter("n > 1").select(F.col("doc_id").alias(id_), F.col("text_key").alias(hash_))
    gone, twice = stored(gone, f"{path}/gone"), stored(twice, f"{path}/twice")
    some = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    left = held.join(some(gone), F.col(id_).eqNullSafe(held["doc_id"]) & (F.col(hash_) == F.col(key)), "left_anti")
    if twice.limit(1).count():
        again = lambda how: left.join(some(twice), F.col(id_).eqNullSafe(left["doc_id"]) & (F.col(hash_) == F.col(key)), how)
        left = again("left_anti").unionByName(again("left_semi").dropDuplicates(["doc_id", key]))
    return left.select(*[F.col(quoted(c)) for c in names])
