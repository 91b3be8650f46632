"""Crowded buckets of near-duplicate search: what is counted before it is joined."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

from paperloom.llm import minhash
from paperloom.llm.common import work_dir


def held(path, name):
    return (Path(path.removeprefix("file://")) / name).exists()


def test_strays_beside_a_component_are_not_banded_anew(spark):
    """Copies of a page, and pages that are a little less than alike to it: their rarest shingles tell them apart, so no node makes FAR_BANDS rows."""
    rng, base = random.Random(31), [f"w{k}" for k in range(120)]
    changed = lambda share: " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in base)
    texts = [changed(0.01) for _ in range(150)] + [changed(0.05) for _ in range(60)]
    docs, path = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), work_dir(spark, "t")
    nodes = minhash.signatures(docs, 5).withColumns({"node": F.col("doc_id"), "doc_min": F.col("doc_id"), "key_min": F.col("text_key")})
    labels = {r.node: r.label for r in minhash.linked_nodes(docs, minhash.stored(nodes, f"{path}/nodes"), 5, 80, path, 10**6).collect()}
    assert held(path, "crowd") and spark.read.parquet(f"{path}/crowd").count() > 150 and held(path, "far-pairs") and not held(path, "far-members")
    sets = [set(minhash.shingle_set(x.encode(), 5).tolist()) for x in texts]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                assert labels[i] == labels[j]


def test_crowded_shingles_go_to_far_bands(spark):
    """Forms whose shingles are all common are banded; what is much alike is found all the same, and beside it what has rare shingles."""
    rng = random.Random(32)
    value = [[[rng.getrandbits(62) for _ in range(4)] for _ in range(2)] for _ in range(40)]
    forms = [[rng.randrange(2) for _ in range(40)] for _ in range(500)]
    forms += [[x ^ (k in off) for k, x in enumerate(forms[i])] for i in range(0, 500, 20) for off in [rng.sample(range(40), 3)]]
    sets = [{v for k, x in enumerate(form) for v in value[k][x]} for form in forms]
    rare = [rng.getrandbits(62) for _ in range(60)]
    sets += [{*rare[:55], rng.getrandbits(62)} for _ in range(5)]
    table, path = spark.createDataFrame([(i, i, len(x), sorted(x)) for i, x in enumerate(sets)], "node long, label long, n long, shingles array<long>"), work_dir(spark, "t")
    got = {(r.a, r.b) for r in minhash.crowd_pairs(minhash.stored(table, f"{path}/sets"), 80, path).collect()}
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 100 * len(a & b) >= 80 * len(a | b)}
    assert held(path, "far-members") and len(want) >= 35 and want <= got and len(got) < 0.03 * len(sets) ** 2 / 2
