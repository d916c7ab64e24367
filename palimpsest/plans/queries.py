"""One query for each operator, over whole tables. Sessions are the conversations; documents stand for long texts; embeddings for stored vectors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import python_text as P
from ..functions import text as X
from ..operators import chunking, context, memory, retrieval
from ..sources import messages as src
from ..sources.store import KEYS, Store

C = Config.small()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def turns(spark: SparkSession, d: str) -> DataFrame:
    return src.segment(src.messages(spark, d))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return chunking.embed(turns(spark, d), C)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(turns(spark, d), C)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return memory.compress(turns(spark, d), C)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "documents").select("doc_id", "text")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# -- Sources and filters ----------------------------------------------------------------------------


@query
def segment_turns(spark, d):
    return turns(spark, d).select("conv_id", "idx", "role", "tok", "content")


@query
def parse_plain_text(spark, d):
    return src.parse_plain(docs(spark, d), "doc_id", "text")


@query
def append_turns(spark, d):
    rows = src.messages(spark, d)
    return src.append(src.segment(rows.where("turn < 4")), rows.where("turn >= 4")).select("conv_id", "idx", "role", "tok")


@query
def normalize_roles(spark, d):
    rows = src.messages(spark, d)
    alias = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "bot").otherwise("tool ")
    raw = F.element_at(F.array(F.col("role"), F.upper("role"), F.concat(F.lit("  "), "role", F.lit(" ")), alias, F.lit("stranger")), (F.col("turn") % 5 + 1).cast("int"))
    return rows.select("conv_id", F.col("turn").alias("idx"), raw.alias("raw")).withColumn("role", X.normalize_role(F.col("raw")))


@query
def fits_in_budget(spark, d):
    return docs(spark, d).select("doc_id", (X.token_count(F.col("text")) <= 60).alias("fits"))


@query
def session_flags(spark, d):
    return turns(spark, d).groupBy("conv_id").agg((F.count("*") >= C.hot_turns).alias("is_full"), (F.count("*") > C.hot_turns).alias("has_evictions"))


# -- Text functions -----------------------------------------------------------------------------------


@query
def token_counts(spark, d):
    return docs(spark, d).select("doc_id", long(X.token_count(F.col("text"))).alias("tok"))


@query
def truncate_text(spark, d):
    return docs(spark, d).select("doc_id", X.truncate(F.col("text"), 20).alias("truncated"))


@query
def count_messages(spark, d):
    return turns(spark, d).groupBy("conv_id").agg(long(F.sum(F.col("tok") + context.MESSAGE_OVERHEAD)).alias("total"))


@query
def sentences(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", long("pos"))


@query
def content_words(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(X.content_words(F.col("text"))).alias("pos", "word")).withColumn("pos", long("pos"))


@query
def top_words(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(X.ranked_words(X.telling_words(F.col("text")), 20)).alias("pos", "x"))
    return rows.select("doc_id", long(F.col("pos") + 1).alias("rank"), "x.word", long(-F.col("x.minus_n")).alias("n"))


def _scored(spark, d, top: int) -> DataFrame:
    """doc_id and the columns of sentence_table, a row for each sentence of a text of two or more."""
    return docs(spark, d).select("doc_id", F.explode(P.sentence_table(F.col("text"), top, C.meso_tokens)).alias("x")).select("doc_id", "x.*")


@query
def sentence_scores(spark, d):
    return _scored(spark, d, 20).select("doc_id", "pos", F.round("score", 6).alias("score"))


@query
def summarizer_trace(spark, d):
    """What the summary of each text looked at: the rounded scores of its sentences, which were picked, and their hits among the top 14 words."""
    return _scored(spark, d, 14).select("doc_id", "pos", (F.floor(F.col("score") * 1000 + F.lit(0.5)) / 1000).alias("score"), "picked", "hits")


@query
def extractive_summary(spark, d):
    rows = docs(spark, d).select("doc_id", P.extractive(F.col("text"), C.meso_tokens).alias("summary"))
    return rows.withColumn("tok", long(X.token_count(F.col("summary"))))


# -- Chunking -------------------------------------------------------------------------------------------


@query
def hashed_embeddings(spark, d):
    return vectors(spark, d).select("conv_id", "idx", F.posexplode("vec").alias("dim", "w")).where("w <> 0").select("conv_id", "idx", long("dim").alias("dim"), F.round("w", 6).alias("w"))


@query
def window_similarity(spark, d):
    return chunking.similarities(vectors(spark, d), C).select("conv_id", "gap", F.round("sim", 6).alias("sim"))


@query
def boundary_candidates(spark, d):
    return chunking.similarities(vectors(spark, d), C).select("conv_id", "gap", (F.col("sim") < C.similarity_threshold).alias("is_boundary"))


@query
def chunk_boundaries(spark, d):
    return chunking.boundaries(vectors(spark, d), C).select("conv_id", F.explode("cuts").alias("b"))


@query
def chunk_assignments(spark, d):
    return chunking.assign(vectors(spark, d), C).select("conv_id", "idx", "chunk_ord")


@query
def chunk_rollup(spark, d):
    return chunks(spark, d).select("conv_id", "chunk_ord", "turn_start", "turn_end", long("tok").alias("tok"), "text")


@query
def chunk_centroids(spark, d):
    return chunks(spark, d).select("conv_id", "chunk_ord", F.posexplode("vec").alias("dim", "w")).where("w <> 0").select("conv_id", "chunk_ord", long("dim").alias("dim"), F.round("w", 6).alias("w"))


@query
def topic_labels(spark, d):
    return chunks(spark, d).select("conv_id", "chunk_ord", F.col("topic").alias("label"))


# -- Summaries and nodes ----------------------------------------------------------------------------------


@query
def micro_summaries(spark, d):
    return turns(spark, d).select("conv_id", "idx", memory.micro(F.col("content"), F.col("tok"), C).alias("micro"))


@query
def meso_summaries(spark, d):
    return chunks(spark, d).select("conv_id", "chunk_ord", memory.meso(F.col("text"), F.col("tok"), C).alias("meso"))


@query
def macro_summary(spark, d):
    return memory.macro(nodes(spark, d), C).select("conv_id", "macro", long(X.token_count(F.col("macro"))).alias("tok"))


def _node() -> list:
    return ["conv_id", "chunk_ord", F.col("topic").alias("label"), "meso", "turn_start", "turn_end", F.col("tok").cast("long").alias("tok")]


@query
def build_nodes(spark, d):
    return nodes(spark, d).select(*_node())


@query
def node_compressed_text(spark, d):
    return nodes(spark, d).select("conv_id", "chunk_ord", F.concat(F.lit("[Topic: "), "topic", F.lit("]\n"), "meso").alias("text"))


@query
def node_json_roundtrip(spark, d):
    rows = nodes(spark, d)
    back = rows.select(F.from_json(F.to_json(F.struct(*rows.columns)), rows.schema).alias("x")).select("x.*")
    return back.select(*_node())


# -- Memory tiers -------------------------------------------------------------------------------------------


@query
def hot_tier(spark, d):
    return memory.hot(turns(spark, d), C).select("conv_id", "idx", "content")


@query
def evicted_turns(spark, d):
    return memory.evicted(turns(spark, d), C).select("conv_id", "idx")


@query
def hot_peek(spark, d):
    return memory.peek(turns(spark, d), C)


_RANGE = ["conv_id", "chunk_ord", "turn_start", "turn_end"]


@query
def evicted_nodes(spark, d):
    return memory.compress(memory.evicted(turns(spark, d), C), C).select(*_RANGE, F.col("topic").alias("label"))


@query
def incremental_nodes(spark, d):
    return memory.compress(memory.evicted(turns(spark, d), C), C, single=True).select(*_RANGE, F.col("topic").alias("label"))


@query
def flush_hot(spark, d):
    return memory.compress(memory.hot(turns(spark, d), C), C).select(*_RANGE, F.col("topic").alias("label"))


@query
def full_pipeline(spark, d):
    """All turns as warm nodes, and each of the last turns in the recent tier besides: the tiers overlap."""
    warm = nodes(spark, d).select(F.lit("warm").alias("tier"), *_RANGE, F.col("topic").alias("label"))
    recent = memory.hot(turns(spark, d), C).select(F.lit("hot").alias("tier"), "conv_id", F.lit(None).cast("long").alias("chunk_ord"), F.col("idx").alias("turn_start"), F.col("idx").alias("turn_end"), F.lit(None).cast("string").alias("label"))
    return warm.unionByName(recent)


@query
def ingest_nodes_totals(spark, d):
    return nodes(spark, d).groupBy("conv_id").agg(long(F.sum(F.col("turn_end") - F.col("turn_start") + 1)).alias("turns"), long(F.sum("tok")).alias("tokens"))


@query
def warm_counts(spark, d):
    return nodes(spark, d).groupBy("conv_id").agg(F.count("*").alias("n"))


@query
def warm_scan_all(spark, d):
    return nodes(spark, d).select(*_RANGE).orderBy("turn_start", "conv_id")


@query
def warm_by_session(spark, d):
    return nodes(spark, d).where("conv_id = 7").select(*_RANGE).orderBy("turn_start")


def _store(spark) -> Store:
    """A store of its own in the folder that all executors share; a local session may name none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="palimpsest-")
    return Store(spark, f"{folder.rstrip('/')}/store-{uuid.uuid4().hex}")


@query
def warm_point_lookup(spark, d):
    """One node by its key from a written store: the session in the key filters the scan."""
    store = _store(spark)
    store.append("nodes", nodes(spark, d))
    rows = store.read("nodes").where("conv_id = 7")
    first = rows.agg(F.min_by("node_id", "turn_start").alias("key"))
    return rows.join(first, F.col("node_id") == F.col("key"), "left_semi").select(*_RANGE)


@query
def nodes_by_turn_range(spark, d):
    return retrieval.overlapping(nodes(spark, d), 2, 3).select(*_RANGE)


@query
def retrieve_by_turn(spark, d):
    asked = turns(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.max("idx").alias("idx"))
    return retrieval.by_turn(nodes(spark, d), asked).select(*_RANGE, "turn")


@query
def warm_upsert_latest(spark, d):
    """A written store of two versions: the second rewrites the nodes of every third session."""
    store = _store(spark)
    store.append("nodes", nodes(spark, d), version=1)
    store.append("nodes", store.read("nodes").where("conv_id % 3 = 0"), version=2)
    return memory.latest(store.log("nodes"), KEYS["nodes"]).select("conv_id", "chunk_ord", "version")


@query
def warm_delete_session(spark, d):
    gone = turns(spark, d).where("conv_id % 5 = 0").select("conv_id").distinct()
    return memory.delete_sessions(nodes(spark, d), gone).groupBy("conv_id").agg(F.count("*").alias("n"))


def _cold(spark, d) -> DataFrame:
    base = turns(spark, d)
    return memory.cold_from_nodes(memory.compress(base, C), base, C)


def _cold_columns() -> list:
    return ["conv_id", F.col("node_count").cast("long").alias("node_count"), F.col("turn_count").cast("long").alias("turn_count"), F.col("tok_orig").cast("long").alias("tok_orig"), "tok_comp", "ratio", "topics"]


@query
def cold_from_nodes(spark, d):
    return _cold(spark, d).select(*_cold_columns())


@query
def cold_latest(spark, d):
    """The archive after sessions with an even id were written a second time with one turn more."""
    store = _store(spark)
    store.append("cold", _cold(spark, d), version=1)
    store.append("cold", store.read("cold").where("conv_id % 2 = 0").withColumn("turn_count", F.col("turn_count") + 1), version=2)
    return store.read("cold").select(*_cold_columns())


@query
def cold_get(spark, d):
    return _cold(spark, d).where("conv_id = 7").select(*_cold_columns())


@query
def cold_index(spark, d):
    return _cold(spark, d).select("conv_id", long("node_count").alias("node_count"), long("turn_count").alias("turn_count"), "ratio", "topics")


@query
def cold_delete(spark, d):
    gone = turns(spark, d).where("conv_id % 5 = 0").select("conv_id").distinct()
    return memory.delete_sessions(_cold(spark, d), gone).select(*_cold_columns())


@query
def tokens_saved(spark, d):
    return memory.tokens_saved(_cold(spark, d))


# -- Retrieval ----------------------------------------------------------------------------------------------


@query
def cosine_topk(spark, d):
    rows = src.table(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return retrieval.vector_search(rows, asked, 10).select("query_id", long("rank").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


@query
def warm_search(spark, d):
    rows = src.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("session"), F.col("vec_id").alias("turn_end"), F.col("embedding").alias("vec"))
    asked = rows.groupBy("session").agg(F.min_by("vec", "turn_end").alias("qvec"), F.min("turn_end").alias("query_id"))
    return retrieval.warm_search(rows, asked, C).select("query_id", long("rank").alias("rank"), F.col("turn_end").alias("vec_id"), F.round("score", 6).alias("score"))


def _hybrid(spark, d) -> DataFrame:
    base = turns(spark, d)
    return retrieval.hybrid(memory.compress(base, C), retrieval.session_queries(base, C), C)


def _stateless(spark, d) -> DataFrame:
    base = turns(spark, d)
    return retrieval.by_cosine(memory.compress(base, C), retrieval.session_queries(base, C), C.top_k)


def _scores(places: int) -> list[Column]:
    # Binary rounding, the same in every engine.
    return [(F.floor(F.col(c) * 10**places + F.lit(0.5)) / 10**places).alias(c) for c in ("sem", "rec", "kw", "composite")]


@query
def stateless_retrieve(spark, d):
    rows = _stateless(spark, d).withColumns({"rec": F.lit(0.0), "kw": F.lit(0.0), "composite": F.col("sem")})
    return rows.select("conv_id", long("rank").alias("rank"), "chunk_ord", *_scores(6))


@query
def keyword_scores(spark, d):
    base = turns(spark, d)
    rows = memory.compress(base, C).join(retrieval.session_queries(base, C), "conv_id")
    return rows.select("conv_id", "chunk_ord", F.round(retrieval.keyword_score(F.col("query"), F.concat_ws(" ", "topic", "meso")), 6).alias("kw"))


@query
def retrieve_hybrid(spark, d):
    return _hybrid(spark, d).select("conv_id", long("rank").alias("rank"), "chunk_ord", *_scores(6))


@query
def result_to_dict(spark, d):
    return _hybrid(spark, d).select("conv_id", long("rank").alias("rank"), "chunk_ord", *_scores(4))


@query
def retrieve_all(spark, d):
    return retrieval.every_node(nodes(spark, d)).select("conv_id", "chunk_ord", F.round("rec", 6).alias("rec"))


# -- Context --------------------------------------------------------------------------------------------------


@query
def context_blocks(spark, d):
    return context.blocks(_stateless(spark, d)).select("conv_id", long("rank").alias("rank"), "block")


@query
def pack_context(spark, d):
    base = turns(spark, d)
    packed = context.pack(_stateless(spark, d), base, C)
    rows = packed.join(context.payload(_stateless(spark, d), base, C).select("conv_id", "token_count", "was_truncated"), "conv_id")
    return rows.select("conv_id", long("rank").alias("rank"), F.coalesce(F.col("included") == "full", F.lit(False)).alias("included"), F.coalesce(F.col("included") == "partial", F.lit(False)).alias("partial"), "was_truncated", "token_count")


def _payload(spark, d) -> DataFrame:
    return context.payload(_stateless(spark, d), turns(spark, d), C)


@query
def context_messages(spark, d):
    return context.as_messages(_payload(spark, d))


@query
def context_string(spark, d):
    return context.as_string(_payload(spark, d)).select("conv_id", "text")


@query
def context_dict(spark, d):
    return _payload(spark, d).select("conv_id", long(F.size("past_blocks")).alias("past_n"), long(F.size("recent")).alias("recent_n"), "token_count", "was_truncated")


@query
def stateless_context(spark, d):
    """The flagship: each session compressed, searched with its last user turn, packed to the budget, as text."""
    rows = context.as_string(_payload(spark, d))
    return rows.select("conv_id", F.col("text").alias("context"), "token_count", long(F.size("past_blocks")).alias("past_n"), long(F.size("recent")).alias("recent_n"), "was_truncated")


# -- Statistics -------------------------------------------------------------------------------------------------


@query
def compression_stats(spark, d):
    base = turns(spark, d)
    rows = memory.compression_stats(base, memory.compress(base, C))
    return rows.select("conv_id", "turns", "chunks", long("raw").alias("raw"), "compressed", "ratio", "token_ratio")


@query
def session_stats(spark, d):
    """Sessions whose older turns are nodes and whose last turns are recent; sessions of five turns or more have an archive row."""
    base = turns(spark, d)
    recent = memory.hot(base, C).groupBy("conv_id").agg(F.count("*").alias("hot"))
    warm = memory.compress(memory.evicted(base, C), C).groupBy("conv_id").agg(F.count("*").alias("warm"), F.sum("tok").alias("warm_tok"))
    all_turns = base.groupBy("conv_id").agg(F.sum("tok").alias("raw"), (F.count("*") >= 5).alias("cold_exists"))
    rows = all_turns.join(recent, "conv_id", "left").join(warm, "conv_id", "left").fillna(0, ["hot", "warm", "warm_tok"])
    return rows.select("conv_id", "hot", "warm", "cold_exists", memory.two_places(F.col("raw") / F.greatest(F.col("warm_tok") + F.col("hot") * 50, F.lit(1))).alias("ratio"))


@query
def sessions_with_status(spark, d):
    """The registry (sessions whose number of turns is even are closed) with the sessions that are open now."""
    registry = turns(spark, d).groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", F.when(F.col("n") % 2 == 0, "closed").otherwise("active").alias("status"))
    active = registry.where("status = 'active' and conv_id % 4 <> 0").select(F.col("conv_id").alias("open_id"))
    return registry.join(active, F.col("conv_id") == F.col("open_id"), "left").select("conv_id", "status", F.col("open_id").isNotNull().alias("is_active"))
