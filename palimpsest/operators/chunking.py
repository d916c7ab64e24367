"""Turns to topic chunks: smoothed similarity, boundary fold, rollup, centroid, label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import Config
from ..functions import python_text as P
from ..functions import text as X
from ..functions import vectors as V


def in_session() -> WindowSpec:
    """Turns of a session in order: one spec for all windows here, so they share one sort."""
    return Window.partitionBy("conv_id").orderBy("idx")


#: A vectorizer turns a text column into an array<double> column; a pandas UDF of a real encoder fits as well.
Vectorizer = Callable[[Column], Column]


def hashed(config: Config) -> Vectorizer:
    return lambda text: P.hashed_embedding(text, config.dim)


def embed(turns: DataFrame, config: Config, vectorizer: Vectorizer | None = None) -> DataFrame:
    return turns.withColumn("vec", (vectorizer or hashed(config))(F.col("content")))


def similarities(vectors: DataFrame, config: Config) -> DataFrame:
    """(conv_id, gap, sim): cosine of the mean vectors of up to `window` turns before and behind each gap. Both frames share one sort."""
    left = F.collect_list("vec").over(in_session().rowsBetween(1 - config.window, 0))
    right = F.collect_list("vec").over(in_session().rowsBetween(1, config.window))
    framed = vectors.select("conv_id", "idx", left.alias("l"), right.alias("r")).where("size(r) > 0")
    cosine = V.cosine(V.mean(F.col("l"), config.dim), V.mean(F.col("r"), config.dim))
    return framed.select("conv_id", F.col("idx").alias("gap"), cosine.alias("sim"))


def boundary_fold(natural: Column, turns: Column, config: Config) -> Column:
    """Boundaries of a session from its natural ones (array of indexes): cap and shortest length in one fold.

    A chunk that began at `start` is cut at a natural boundary or at the cap; of those cuts only the ones that lie `min_turns` behind the last kept stay.
    """
    start = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("kept"), F.array().cast("array<long>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        cut = F.array_contains(natural, i) | (i - s["start"] >= config.max_turns)
        keep = cut & (i - s["kept"] >= config.min_turns)
        return F.struct(F.when(cut, i).otherwise(s["start"]).alias("start"), F.when(keep, i).otherwise(s["kept"]).alias("kept"), F.when(keep, F.concat(s["out"], F.array(i))).otherwise(s["out"]).alias("out"))

    last = F.greatest(turns - 1, F.lit(0)).cast("long")
    return F.aggregate(F.sequence(F.lit(0).cast("long"), last), start, step, lambda s: s["out"])


def boundaries(vectors: DataFrame, config: Config) -> DataFrame:
    """(conv_id, cuts): the indexes at which a session's chunks begin, the first chunk's 0 left out."""
    gaps = similarities(vectors, config).where(F.col("sim") < config.similarity_threshold).groupBy("conv_id").agg(F.array_sort(F.collect_list((F.col("gap") + 1).cast("long"))).alias("natural"))
    sizes = vectors.groupBy("conv_id").agg(F.count("*").alias("n"))
    joined = sizes.join(gaps, "conv_id", "left").withColumn("natural", F.coalesce("natural", F.array().cast("array<long>")))
    return joined.select("conv_id", boundary_fold(F.col("natural"), F.col("n"), config).alias("cuts"))


def assign(vectors: DataFrame, config: Config, single: bool = False) -> DataFrame:
    """Turns with their chunk_ord. `single`: each turn is a chunk, as when turns leave the recent buffer one by one."""
    if single:
        return vectors.withColumn("chunk_ord", (F.row_number().over(in_session()) - 1).cast("long"))
    base = vectors.withColumn("place", (F.row_number().over(in_session()) - 1).cast("long"))
    renumbered = base.withColumn("idx_", F.col("idx")).withColumn("idx", F.col("place"))
    cuts = boundaries(renumbered, config)
    out = renumbered.join(cuts, "conv_id").withColumn("chunk_ord", F.size(F.filter("cuts", lambda b: b <= F.col("place"))).cast("long"))
    return out.withColumn("idx", F.col("idx_")).drop("idx_", "place", "cuts")


def label(words: Column, start: Column, end: Column) -> Column:
    named = lambda top: F.when(F.size(top) > 0, F.array_join(top, " · ")).otherwise(F.concat(F.lit("turns "), start.cast("string"), F.lit("-"), end.cast("string")))
    return X.let(X.top_words(words, 3), named)


def rollup(chunked: DataFrame, config: Config) -> DataFrame:
    """One row for each chunk: turn range, tokens, text, label, centroid, and its turns in order."""
    turn = F.struct("idx", "role", "content", "tok", "vec")
    rows = chunked.groupBy("conv_id", "chunk_ord").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.sum("tok").alias("tok"), F.min("idx").alias("turn_start"), F.max("idx").alias("turn_end"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    words = F.flatten(F.transform("turns", lambda t: X.telling_words(t["content"])))
    rows = rows.withColumn("text", text).withColumn("words", words).withColumn("vec", V.normalize(V.mean(F.transform("turns", lambda t: t["vec"]), config.dim)))
    return rows.withColumn("topic", label(F.col("words"), F.col("turn_start"), F.col("turn_end"))).drop("words")


def chunk(turns: DataFrame, config: Config, single: bool = False, vectorizer: Vectorizer | None = None) -> DataFrame:
    return rollup(assign(embed(turns, config, vectorizer), config, single), config)
