"""Connected components of an edge table by alternating star contractions, each round cut off from the last by a written table; one task settles the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, staged, staged_at, unstage

#: Parts that the links of one node are dealt to when they meet its smallest neighbour, so that a star's centre isn't one task's.
SALTS = 16
#: Links, of two longs, that one task settles by itself: 16 MB, whatever the input. Rounds of a few links cost the driver as much as those of many.
FEW = 1 << 20


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (u, v), ascending, and the smallest node that each one reaches."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    # Each root that meets a smaller one goes below it: half of those that still have a link at least, in each turn.
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root != (up := root[root])).any():
            root = up
    return nodes, nodes[root]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[batch.column(c).to_numpy() for c in ("u", "v")] for batch in batches if batch.num_rows]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))], ["node", "component"])


def _with_least(links: DataFrame, other: str, least: DataFrame) -> DataFrame:
    """links (u, other) with m of `least` (u, m)."""
    salt: Column = F.pmod(F.xxhash64(other), F.lit(SALTS))
    copies = least.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return links.withColumn("salt", salt).join(copies, ["u", "salt"]).drop("salt")


def _only_stars(links: DataFrame) -> bool:
    """Whether distinct links (u, v) with u > v are whole stars: each u has one v, and no v is another link's u. Then v is its component's smallest node."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    by = ends.groupBy("node").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v"))
    return by.where("as_u > 1 or (as_u = 1 and as_v = 1)").agg(F.count("*")).collect()[0][0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, component): every node of an edge, and the smallest node that it reaches.

    A round points each node's larger neighbours, then its smaller ones, at its smallest neighbour; all tables stay linear in the edges, and a node of
    any degree is summed up by partial aggregation and met in SALTS parts. A round's table goes when the next is written; there is none for links that are
    stars already, and none to see that the last one changed nothing. FEW links or fewer need no more rounds. Self-loops and repeated edges
    are allowed, nulls are not.
    """
    spark = edges.sparkSession
    links, path = staged_at(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while (many := links.count() > FEW) and not _only_stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: neighbours above u go to u's smallest.
        above = links.select(F.col("v").alias("u"), F.col("u").alias("w")).unionByName(links.select("u", F.col("u").alias("w")))
        large = _with_least(above, "w", low).select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its neighbours below go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, "v", least).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        done = path
        links, path = staged_at(small, "links")
        unstage(spark, done)
    if not many:
        out = staged(links.repartition(1).mapInArrow(lean(_settle), "node long, component long"), "components")
        unstage(spark, path)
        return out
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
