"""Messages to turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text) messages of all sessions."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def segment(rows: DataFrame) -> DataFrame:
    """Messages -> turns (conv_id, idx, role, content, tok): stripped, blank ones dropped, indexed anew in order.

    Rows are dealt by session once; every later window and aggregate of a session keeps that partitioning.
    """
    clean = rows.select("conv_id", "turn", X.normalize_role(F.col("role")).alias("role"), X.strip(F.coalesce("text", F.lit(""))).alias("content")).where("content <> ''")
    order = Window.partitionBy("conv_id").orderBy("turn")
    out = clean.repartition("conv_id").withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    return out.select("conv_id", "idx", "role", "content", X.token_count(F.col("content")).cast("long").alias("tok"))


def append(history: DataFrame, added: DataFrame) -> DataFrame:
    """Turns of `history` and, behind them, those of the messages `added` one by one; appended blank messages stay, as turns of no tokens."""
    last = history.groupBy("conv_id").agg((F.max("idx") + 1).alias("next"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = added.select("conv_id", "turn", X.normalize_role(F.col("role")).alias("role"), X.strip(F.coalesce("text", F.lit(""))).alias("content"))
    rows = rows.join(last, "conv_id", "left").withColumn("idx", F.row_number().over(order) - 1 + F.coalesce("next", F.lit(0)))
    return history.unionByName(rows.select("conv_id", F.col("idx").cast("long").alias("idx"), "role", "content", X.token_count(F.col("content")).cast("long").alias("tok")))


def parse_plain(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Plain text -> (key, idx, role, content): a row for each non-blank line; a role prefix counts, else roles alternate over the non-blank lines."""
    prefix = "(?i)^(user|human|assistant|ai|system)\\s*:\\s*"
    pieces = F.filter(F.transform(F.split(F.col(text), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"), X.strip), lambda x: x != "")
    lines = rows.select(key, F.posexplode(pieces).alias("line", "raw"))
    named = F.regexp_extract("raw", prefix, 1)
    role = F.when(named != "", X.normalize_role(named)).otherwise(F.when(F.col("line") % 2 == 0, "user").otherwise("assistant"))
    content = F.when(named != "", X.strip(F.regexp_replace("raw", prefix, ""))).otherwise(F.col("raw"))
    kept = lines.select(key, "line", role.alias("role"), content.alias("content")).where("content <> ''")
    order = Window.partitionBy(key).orderBy("line")
    return kept.select(key, (F.row_number().over(order) - 1).cast("long").alias("idx"), "role", "content")
