"""Context payloads: blocks, budget packing, messages, string and dict forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as X
from .memory import hot

SYSTEM_NOTE = "Earlier parts of this conversation are given as topic summaries under past context. The latest messages follow word for word under recent context. Answer from both."
# The payload's headers, separator and overheads.
PAST_HEADER, RECENT_HEADER, SEPARATOR = "=== PAST CONTEXT (compressed) ===", "=== RECENT CONTEXT ===", "---"
MESSAGE_OVERHEAD, PAYLOAD_OVERHEAD, LEAST_PARTIAL, CUT_SLACK = 4, 50, 30, 5


def head(topic: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("[Topic: "), topic, F.lit("] (turns "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")"))


def block(topic: Column, start: Column, end: Column, meso: Column, micros: Column | None = None) -> Column:
    lines = [F.array(head(topic, start, end), meso)]
    if micros is not None:
        lines.append(F.transform(micros, lambda m: F.concat(F.lit("  - "), m)))
    return F.array_join(F.concat(*lines, F.array(F.lit(SEPARATOR))), "\n")


def cut_block(topic: Column, start: Column, end: Column, meso: Column, tokens: Column) -> Column:
    title = head(topic, start, end)
    return F.array_join(F.array(title, X.truncate(meso, tokens - X.token_count(title) - CUT_SLACK), F.lit(SEPARATOR)), "\n")


def blocks(ranked: DataFrame, include_micro: bool = False) -> DataFrame:
    """Ranked nodes with their block text and its tokens."""
    text = block(F.col("topic"), F.col("turn_start"), F.col("turn_end"), F.col("meso"), F.col("micros") if include_micro else None)
    return ranked.withColumn("block", text).withColumn("block_tok", X.token_count(F.col("block")).cast("long"))


def recent(turns: DataFrame, config: Config) -> DataFrame:
    """(conv_id, recent, recent_tok): the last turns in order, and their tokens with each message's overhead."""
    rows = hot(turns, config).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "role", "content"))).alias("recent"), F.sum(F.col("tok") + MESSAGE_OVERHEAD).alias("recent_tok"))
    return rows


def pack(ranked: DataFrame, turns: DataFrame, config: Config, include_micro: bool = False) -> DataFrame:
    """Ranked blocks with `included` ('full', 'partial' or null), the final block text, and the session's budget.

    Blocks are taken up to the first that overflows: a running sum. That one is cut to what is left if more than LEAST_PARTIAL tokens are; later ones are never considered.
    """
    budget = F.lit(config.context_tokens) - X.token_count(F.lit(SYSTEM_NOTE)) - F.col("recent_tok") - PAYLOAD_OVERHEAD
    rows = blocks(ranked, include_micro).join(recent(turns, config), "conv_id").withColumn("budget", budget)
    order = Window.partitionBy("conv_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cum", F.sum("block_tok").over(order))
    before = F.col("cum") - F.col("block_tok")
    first_over = (F.col("cum") > F.col("budget")) & ((before <= F.col("budget")) | (F.col("rank") == 1))
    state = F.when(F.col("cum") <= F.col("budget"), "full").when(first_over & (F.col("budget") - before > LEAST_PARTIAL), "partial")
    cut = cut_block(F.col("topic"), F.col("turn_start"), F.col("turn_end"), F.col("meso"), F.col("budget") - before)
    rows = rows.withColumn("included", state).withColumn("final", F.when(F.col("included") == "full", F.col("block")).when(F.col("included") == "partial", cut))
    return rows.withColumn("over", F.col("cum") > F.col("budget"))


def payload(ranked: DataFrame, turns: DataFrame, config: Config, include_micro: bool = False) -> DataFrame:
    """One row for each session: past blocks, recent turns, tokens, node ids, was_truncated. Sessions without results get their recent turns alone."""
    packed = pack(ranked, turns, config, include_micro)
    kept = F.when(F.col("included").isNotNull(), F.struct("rank", "final", "node_id"))
    past = packed.groupBy("conv_id").agg(F.array_sort(F.collect_list(kept)).alias("past"), F.max("over").alias("was_truncated"))
    rows = recent(turns, config).join(past, "conv_id", "left")
    fixed = X.token_count(F.lit(SYSTEM_NOTE)) + PAYLOAD_OVERHEAD
    past_tok = F.aggregate("past", F.lit(0), lambda s, p: s + X.token_count(p["final"]))
    return rows.select(
        "conv_id", F.transform(F.coalesce("past", F.array().cast("array<struct<rank:int,final:string,node_id:string>>")), lambda p: p["final"]).alias("past_blocks"),
        F.transform(F.coalesce("past", F.array().cast("array<struct<rank:int,final:string,node_id:string>>")), lambda p: p["node_id"]).alias("node_ids"), "recent",
        F.when(F.col("past").isNull(), F.col("recent_tok")).otherwise(F.col("recent_tok") + fixed + past_tok).cast("long").alias("token_count"), F.coalesce("was_truncated", F.lit(False)).alias("was_truncated"),
    )


def as_messages(payloads: DataFrame) -> DataFrame:
    """(conv_id, pos, role, content): a system message, then the recent turns."""
    some = F.size("past_blocks") > 0
    system = F.when(some, F.array_join(F.concat(F.array(F.lit(SYSTEM_NOTE), F.lit(""), F.lit(PAST_HEADER)), F.col("past_blocks")), "\n")).otherwise(F.lit(SYSTEM_NOTE))
    every = F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), F.transform("recent", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))))
    return payloads.select("conv_id", F.posexplode(every).alias("pos", "m")).select("conv_id", F.col("pos").cast("long").alias("pos"), "m.role", "m.content")


def as_string(payloads: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    past = F.when(F.size("past_blocks") > 0, F.concat(F.array(F.lit(PAST_HEADER)), F.col("past_blocks"), F.array(F.lit("")))).otherwise(none)
    last = F.when(F.size("recent") > 0, F.concat(F.array(F.lit(RECENT_HEADER)), F.transform("recent", lambda t: F.concat(F.upper(t["role"]), F.lit(": "), t["content"])))).otherwise(none)
    return payloads.withColumn("text", F.array_join(F.concat(F.array(F.lit(SYSTEM_NOTE), F.lit("")), past, last), "\n"))


def as_dict(payloads: DataFrame) -> DataFrame:
    body = F.struct(F.lit(SYSTEM_NOTE).alias("system_note"), "past_blocks", F.transform("recent", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("recent_turns"), "token_count", F.col("node_ids").alias("retrieved_node_ids"), "was_truncated", F.size("past_blocks").alias("past_block_count"), F.size("recent").alias("recent_turn_count"))
    return payloads.withColumn("json", F.to_json(body))
