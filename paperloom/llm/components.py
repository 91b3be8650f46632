"""Connected components of a link table.

Up to LOCAL_LINKS links, a bounded number, are joined in one executor task (union-find over arrays). Beyond
that it's alternating stars. Each round shuffles links once or twice and joins only each node's smallest neighbour, so no node's
neighbours are ever gathered in one task. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import stored

#: Links that one task may join, 16 bytes each and as much again for its work.
LOCAL_LINKS = 2_000_000


def joined_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and each one's label, the smallest node of its component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(nodes))
    for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        up[max(x, y)] = min(x, y)
    while True:
        above = up[up]
        if (above == up).all():
            return nodes, nodes[up]
        up = above


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v) with u > v in; each node's neighbours are tied to its smallest one."""
    if large:  # all neighbours count; the larger ones move
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        moved = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours count, and move with the node itself
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def components(links: DataFrame, path: str, local_links: int = LOCAL_LINKS, most_rounds: int = 50) -> DataFrame:
    """node and label, the smallest node it is linked to, for each node of links(a, b) (long). Nodes without links are not in it.

    links must be a stored table, as it is counted first; path: a shared folder for the rounds' tables.
    """
    if links.count() <= local_links:

        def join(batches):
            parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
            if parts:
                nodes, labels = joined_labels(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(labels, pa.int64())], names=["node", "label"])

        return links.select("a", "b").coalesce(1).mapInArrow(join, "node long, label long")
    now = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), f"{path}/round-0"
    )
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    for k in range(1, most_rounds):
        now = stored(_star(_star(now, True), False), f"{path}/round-{k}")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    # every link now leads from a node to its label
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
