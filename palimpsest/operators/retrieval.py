"""Ranking of memory nodes for a query: cosine, recency, keywords, and two-stage top-k."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal, localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import python_text as P
from ..functions import text as X
from ..functions import vectors as V


def session_queries(turns: DataFrame, config: Config) -> DataFrame:
    """(conv_id, query, qvec): each session's last user turn; sessions without one drop out."""
    rows = turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("content", "idx").alias("query"))
    return rows.withColumn("qvec", P.hashed_embedding(F.col("query"), config.dim))


def keywords(text: Column) -> Column:
    """Distinct words of a query or node that say what it is about."""
    return F.array_distinct(F.filter(X.content_words(text), lambda w: ~w.isin(X.QUERY_STOP_WORDS)))


def keyword_score(query: Column, target: Column) -> Column:
    """Share of the query's keywords that the target has; 0 where either has none."""
    both = F.struct(keywords(query).alias("q"), keywords(target).alias("t"))
    return X.let(both, lambda x: F.when((F.size(x["q"]) == 0) | (F.size(x["t"]) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x["q"], x["t"])) / F.size(x["q"])))


def _ranked(keys: list[str], score: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), "turn_start", "chunk_ord"))


def by_cosine(nodes: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """Each session's `most` nodes by cosine. Ranks above the limit are dropped before the final sort."""
    scored = nodes.join(queries, "conv_id").withColumn("sem", F.round(V.dot(F.col("vec"), F.col("qvec")), 9))
    return scored.withColumn("rank", _ranked(["conv_id"], "sem")).where(F.col("rank") <= most)


def hybrid(nodes: DataFrame, queries: DataFrame, config: Config) -> DataFrame:
    """Top 2k by cosine, ranked anew by cosine + recency among the candidates + keywords, cut to k."""
    found = by_cosine(nodes, queries, 2 * config.top_k).drop("rank")
    every = Window.partitionBy("conv_id")
    found = found.withColumn("rec", F.col("turn_end") / F.greatest(F.max("turn_end").over(every), F.lit(1)) * config.recency_boost)
    found = found.withColumn("kw", keyword_score(F.col("query"), F.concat_ws(" ", "topic", "meso")) * config.keyword_weight)
    found = found.withColumn("composite", F.round(F.col("sem") + F.col("rec") + F.col("kw"), 9))
    order = Window.partitionBy("conv_id").orderBy(F.col("composite").desc(), F.col("sem").desc(), "turn_start", "chunk_ord")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_k)


def every_node(nodes: DataFrame) -> DataFrame:
    """All nodes in turn order; recency is the place among them."""
    order = Window.partitionBy("conv_id").orderBy("turn_start", "chunk_ord")
    every = Window.partitionBy("conv_id")
    return nodes.withColumn("rec", (F.row_number().over(order) - 1) / F.greatest(F.count("*").over(every) - 1, F.lit(1))).withColumn("composite", F.lit(1.0))


def overlapping(nodes: DataFrame, first: int, last: int) -> DataFrame:
    return nodes.where((F.col("turn_start") <= last) & (F.col("turn_end") >= first))


def by_turn(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of a session that hold a turn: a range join under the session's equality."""
    asked = turns.select(F.col("conv_id"), F.col("idx").alias("turn"))
    return nodes.join(asked, "conv_id").where(F.col("turn").between(F.col("turn_start"), F.col("turn_end")))


#: Queries that meet the vectors in one pass: a broadcast of about this many vectors. Vectors of a step.
QUERY_BLOCK, STEP_ROWS = 1024, 2048


def _plain_dot(a: list | None, b: list | None) -> float | None:
    """V.dot of two arrays as they come."""
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Nine places as Spark rounds them: half up in decimal digits."""
    values, back = np.unique(scores, return_inverse=True)
    with localcontext() as context:
        context.prec = 400
        return np.array([float(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for x in values.tolist()])[back]


def _plain_rows(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which arrays hold `dim` ordinary numbers, and those as a matrix of doubles."""
    if dim == 0:
        return np.zeros(len(lists), bool), np.zeros((0, 1))
    fits = pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False)
    rows = pc.list_flatten(lists.filter(fits)).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    plain = (np.abs(rows) < 1e100).all(1)  # neither null nor NaN
    out = fits.to_numpy(zero_copy_only=False).copy()
    out[out] = plain
    return out, rows[plain]


def _sequential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up in the order of V.dot."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


class _Best:
    """The best `most` vectors of each query so far: a matrix product finds what may be among them, and those are computed exactly."""

    def __init__(self, queries: np.ndarray, most: int) -> None:
        self.queries, self.most = queries, most
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(queries), -np.inf)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        near = rows @ self.queries.T
        # Rounding to nine places, and what the order of a sum can change.
        slack = 2e-9 + 1e-12 * np.sqrt((self.queries**2).sum(1)) * np.sqrt((rows**2).sum(1)).max()
        least = self.least
        if len(ids) > self.most and np.isinf(least).any():
            least = np.maximum(least, np.partition(near, len(ids) - self.most, axis=0)[len(ids) - self.most] - slack)
        row, query = np.nonzero(near >= least - slack)
        for a in range(0, len(row), 1 << 18):
            r, q = row[a : a + (1 << 18)], query[a : a + (1 << 18)]
            self._merge(q, ids[r], _rounded(_sequential(rows[r], self.queries[q])))

    def _merge(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = np.concatenate([self.query, query]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        begins = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        place = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
        last = place == self.most - 1
        self.least[query[last]] = score[last]
        kept = place < self.most
        self.query, self.id, self.score = query[kept], ids[kept], score[kept]


def _search(block, most: int):
    """Each task's best vectors of each query of a block. Rows and queries that hold anything but ordinary numbers are scored one by one, all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lists = block.value
        if not names:
            return
        dim = next((len(v) for v in lists if v), 0)
        plain, queries = _plain_rows(pa.array(lists, pa.list_(pa.float64())), dim)
        odd = np.flatnonzero(~plain).tolist()
        best = _Best(queries, most)

        def table(query: list, vec: list, score: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

        for whole in batches:
            for a in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(a, STEP_ROWS)
                ids, vectors = batch.column("vec_id"), batch.column("embedding")
                good, rows = _plain_rows(vectors, dim)
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                rows, good = rows[named[good]], good & named
                if len(rows) and len(queries):
                    best.add(ids.filter(pa.array(good)).to_numpy(), rows)
                for k in range(len(good)) if odd else np.flatnonzero(~good).tolist():
                    own, some = vectors[k].as_py(), odd if good[k] else range(len(names))
                    yield table([names[q] for q in some], [ids[k].as_py()] * len(some), [_plain_dot(own, lists[q]) for q in some])
        yield table([names[q] for q in np.flatnonzero(plain)[best.query].tolist()], best.id.tolist(), best.score.tolist())

    return run


def vector_search(vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, rank, vec_id, score): exact top-k of all vectors for a stated query set (query_id, qvec), block by block.

    A block of about QUERY_BLOCK queries is broadcast, whatever their number; each task keeps its best `most` of each query before anything is shuffled.
    """
    parts = queries.count() // QUERY_BLOCK + 1
    dealt = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("qvec").cast("array<double>").alias("qvec"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = None
    for part in range(parts):
        own = dealt.where(F.col("part") == part).collect()
        block = vectors.sparkSession.sparkContext.broadcast(([r.query_id for r in own], [r.qvec for r in own]))
        scored = rows.mapInArrow(_search(block, most), "query_id long, vec_id long, score double")
        found = scored if found is None else found.unionByName(scored)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")


def warm_search(vectors: DataFrame, queries: DataFrame, config: Config) -> DataFrame:
    """Nodes (session, turn_end, vec) against their session's query vector, with recency where the session has more than one node."""
    every = Window.partitionBy("session")
    joined = vectors.join(queries, "session")
    boost = F.when((F.count("*").over(every) > 1) & (F.max("turn_end").over(every) > 0), F.col("turn_end") / F.max("turn_end").over(every) * config.recency_boost).otherwise(F.lit(0.0))
    scored = joined.withColumn("boost", boost).withColumn("score", F.round(V.dot(F.col("vec"), F.col("qvec")) + F.col("boost"), 9))
    order = Window.partitionBy("session").orderBy(F.col("score").desc(), "turn_end")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_k)
