"""Summaries, memory nodes, and the recent, warm and cold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import python_text as P
from ..functions import text as X
from .chunking import Vectorizer, chunk

def two_places(x: Column) -> Column:
    """Rounded to two places in binary arithmetic, the same in every engine."""
    return F.floor(x * 100 + F.lit(0.5)) / 100


def micro(content: Column, tok: Column, config: Config) -> Column:
    return F.when(tok <= config.micro_tokens, content).otherwise(P.extractive(F.when(tok > config.micro_tokens, content), config.micro_tokens))


def meso(text: Column, tok: Column, config: Config) -> Column:
    return F.when(tok <= config.meso_tokens, text).otherwise(P.extractive(F.when(tok > config.meso_tokens, text), config.meso_tokens))


def node_id(conv_id: Column, start: Column, end: Column) -> Column:
    """A node's key follows from its session and turns, so a rerun writes the same node."""
    return F.sha2(F.concat_ws(":", conv_id.cast("string"), start.cast("string"), end.cast("string")), 256)


def build_nodes(chunks: DataFrame, config: Config) -> DataFrame:
    """Chunks -> memory nodes: label, topic summary, one summary a turn, centroid."""
    named = lambda m: F.when(F.trim(m) == "", F.concat(F.lit("Conversation about: "), F.col("topic"))).otherwise(m)
    out = chunks.withColumn("meso", X.let(meso(F.col("text"), F.col("tok"), config), named))
    micros = P.each_extractive(F.col("turns.content"), F.col("turns.tok"), config.micro_tokens)
    key = node_id(F.col("conv_id"), F.col("turn_start"), F.col("turn_end"))
    return out.select(key.alias("node_id"), "conv_id", "chunk_ord", "topic", "meso", micros.alias("micros"), "turn_start", "turn_end", "tok", "vec")


def compress(turns: DataFrame, config: Config, single: bool = False, vectorizer: Vectorizer | None = None) -> DataFrame:
    return build_nodes(chunk(turns, config, single, vectorizer), config)


def macro(nodes: DataFrame, config: Config, filled: bool = False) -> DataFrame:
    """(conv_id, macro, node_count, topics, tok_nodes): the session's topic summaries in order, summarised where they are long. `filled`: only sessions with one."""
    rows = nodes.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk_ord", "meso", "topic"))).alias("ns"), F.count("*").alias("node_count"), F.sum("tok").alias("tok_nodes"))
    joined = F.array_join(F.transform(F.filter("ns", lambda n: n["meso"] != ""), lambda n: n["meso"]), "\n\n")
    if filled:  # told by the nodes: a filter by the text would have it summarised twice
        rows = rows.where(F.exists("ns", lambda n: n["meso"] != ""))
    text = P.extractive(joined, config.macro_tokens, whole=True)
    return rows.select("conv_id", text.alias("macro"), "node_count", F.transform("ns", lambda n: n["topic"]).alias("topics"), "tok_nodes")


# -- The recent tier ----------------------------------------------------------------------------------


def _from_last(turns: DataFrame) -> DataFrame:
    return turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("idx").desc())))


def hot(turns: DataFrame, config: Config) -> DataFrame:
    """Each session's last turns."""
    return _from_last(turns).where(F.col("back") <= config.hot_turns).drop("back")


def evicted(turns: DataFrame, config: Config) -> DataFrame:
    """The turns that have left the recent tier, each once."""
    return _from_last(turns).where(F.col("back") > config.hot_turns).drop("back")


def peek(turns: DataFrame, config: Config) -> DataFrame:
    return hot(turns, config).groupBy("conv_id").agg(F.min_by("content", "idx").alias("oldest"), F.max_by("content", "idx").alias("newest"))


# -- The warm tier: an append log with versions ---------------------------------------------------------


def latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each key; a newest version that is a tombstone (deleted) hides the key."""
    order = Window.partitionBy(*keys).orderBy(F.col("version").desc())
    return log.withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_").where("not deleted").drop("deleted")


def upsert(log: DataFrame, rows: DataFrame, version: int) -> DataFrame:
    return log.unionByName(rows.withColumn("version", F.lit(version).cast("long")).withColumn("deleted", F.lit(False)))


def delete_sessions(nodes: DataFrame, sessions: DataFrame) -> DataFrame:
    return nodes.join(sessions, "conv_id", "left_anti")


# -- The cold tier --------------------------------------------------------------------------------------


def cold_from_nodes(nodes: DataFrame, turns: DataFrame, config: Config) -> DataFrame:
    """One archive row for each session with a summary."""
    totals = turns.groupBy("conv_id").agg(F.count("*").alias("turn_count"), F.sum("tok").alias("tok_orig"))
    rows = macro(nodes, config, filled=True).join(totals, "conv_id")
    compressed = X.token_count(F.col("macro")).cast("long")
    ratio = two_places(F.col("tok_orig") / F.greatest(compressed, F.lit(1)))
    return rows.select("conv_id", "macro", "node_count", "turn_count", "tok_orig", compressed.alias("tok_comp"), ratio.alias("ratio"), F.array_join("topics", " | ").alias("topics"))


def tokens_saved(cold: DataFrame) -> DataFrame:
    each = (F.col("node_count") * 200 * (F.col("ratio") - 1)).cast("long")
    return cold.agg(F.coalesce(F.sum(each), F.lit(0)).alias("total"))


def compression_stats(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """Turns, chunks, raw tokens, words of the summaries, their ratio, and the ratio in tokens."""
    raw = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("tok").alias("raw"))
    short = nodes.groupBy("conv_id").agg(F.count("*").alias("chunks"), F.sum(F.when(X.strip(F.col("meso")) == "", 0).otherwise(F.size(X.words(F.col("meso"))))).cast("long").alias("compressed"), F.sum(X.token_count(F.col("meso"))).cast("long").alias("compressed_tokens"))
    rows = raw.join(short, "conv_id")
    return rows.select("conv_id", "turns", "chunks", "raw", "compressed", two_places(F.col("raw") / F.greatest("compressed", F.lit(1))).alias("ratio"), two_places(F.col("raw") / F.greatest("compressed_tokens", F.lit(1))).alias("token_ratio"))

