"""The session facade: the calls of a conversation service over the memory tables, for one session at a time or for many at once.

Every call returns {"status": "ok", ...} or {"status": "error", "message": ...}. State is in the tables alone: indexes go on from the stored maximum after a
reopen, a turn is compressed once (the registry knows up to which index, through closing and reopening), and sessions are columns, never paths. Blank messages are
not turns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import text as X
from .functions import vectors as V
from .operators import context, memory, retrieval
from .operators.chunking import Vectorizer
from .sources import messages as src
from .sources.store import Store

ROLES = ("user", "human", "assistant", "ai", "bot", "model", "system", "tool")


def _enveloped(f: Callable) -> Callable:
    @wraps(f)
    def call(*args, **kwargs) -> dict:
        try:
            return {"status": "ok", **f(*args, **kwargs)}
        except ValueError as e:
            return {"status": "error", "message": str(e)}

    return call


def _plain(conv_id: int, content: list[dict]) -> None:
    if not isinstance(conv_id, int) or isinstance(conv_id, bool):
        raise ValueError("a session id is an integer")
    if not content:
        raise ValueError("at least one message is needed")
    for m in content:
        if set(m) - {"role", "content"}:
            raise ValueError("a message has a role and a content")
        if m.get("role") is not None and m["role"].strip().lower() not in ROLES:
            raise ValueError(f"unknown role {m['role']}")
    if not any((m.get("content") or "").strip() for m in content):
        raise ValueError("a message has a content that is not blank")


class Sessions:
    """Open, ingest, search, summarise, close and delete sessions kept under one path."""

    def __init__(self, spark: SparkSession, base: str, config: Config | None = None, vectorizer: Vectorizer | None = None) -> None:
        """vectorizer: text column to vector column, of turns and of questions alike; the default hashes words."""
        self.spark, self.config, self.store, self.vectorizer = spark, config or Config(), Store(spark, base), vectorizer

    # -- ingestion --

    def ingest(self, rows: DataFrame) -> None:
        """Messages (conv_id, turn, role, text) of any number of sessions: turns are appended, what leaves the recent tier becomes nodes."""
        ids = rows.select("conv_id").distinct()
        known = self.store.read("turns").join(ids, "conv_id", "left_semi")
        old = self.store.read("registry").join(ids, "conv_id", "left_semi").select("conv_id", "done_to", "created_at")
        grown = src.append(known, rows.where(X.strip(F.coalesce("text", F.lit(""))) != ""))
        added = grown.join(known.select("conv_id", "idx"), ["conv_id", "idx"], "left_anti")
        done = F.coalesce("done_to", F.lit(0).cast("long"))
        leaving = memory.evicted(grown, self.config).join(old, "conv_id", "left").where(F.col("idx") >= done).select(*grown.columns)
        nodes = memory.compress(leaving, self.config, vectorizer=self.vectorizer)
        counts = grown.groupBy("conv_id").agg(F.count("*").alias("turn_count")).join(old, "conv_id", "left")
        done_to = F.greatest(done, F.col("turn_count") - self.config.hot_turns, F.lit(0)).cast("long").alias("done_to")
        counts = counts.select("conv_id", F.lit("active").alias("status"), "turn_count", done_to, F.coalesce("created_at", F.current_timestamp()).alias("created_at"), F.current_timestamp().alias("last_active"))
        # Nodes and turns are written before the count that says so: an interrupted call writes the same keys again.
        self.store.append("nodes", nodes)
        self.store.append("turns", added)
        self.store.append("registry", counts)

    @_enveloped
    def ingest_turn(self, conv_id: int, role: str, content: str) -> dict:
        return self._ingest_list(conv_id, [{"role": role, "content": content}])

    @_enveloped
    def ingest_history(self, conv_id: int, messages: list[dict]) -> dict:
        return self._ingest_list(conv_id, messages)

    def _ingest_list(self, conv_id: int, messages: list[dict]) -> dict:
        _plain(conv_id, messages)
        rows = [(conv_id, i, m.get("role"), m.get("content") or "") for i, m in enumerate(messages)]
        self.ingest(self.spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        return {"conv_id": conv_id, "ingested": sum(1 for r in rows if r[3].strip())}

    # -- reading --

    def _turns(self, conv_id: int) -> DataFrame:
        return self.store.read("turns").where(F.col("conv_id") == conv_id)

    def _nodes(self, conv_id: int) -> DataFrame:
        return self.store.read("nodes").where(F.col("conv_id") == conv_id)

    @_enveloped
    def retrieve_context(self, conv_id: int, query: str, top_k: int | None = None, fmt: str = "messages", include_micro: bool = False) -> dict:
        if top_k is not None and not 0 <= top_k <= 20:
            raise ValueError("top_k lies between 1 and 20; 0 is the default")
        config = Config(**{**self.config.__dict__, "top_k": top_k or self.config.top_k})
        asked = self.spark.createDataFrame([(conv_id, query)], "conv_id long, query string").withColumn("qvec", self.vectorizer(F.col("query")) if self.vectorizer else V.hashed_embedding(F.col("query"), config.dim))
        ranked = retrieval.hybrid(self._nodes(conv_id), asked, config)
        payload = context.payload(ranked, self._turns(conv_id), config, include_micro)
        if fmt == "messages":
            return {"context": [{"role": r.role, "content": r.content} for r in context.as_messages(payload).orderBy("pos").collect()]}
        if fmt == "string":
            return {"context": next((r.text for r in context.as_string(payload).select("text").collect()), "")}
        return {"context": next((r.json for r in context.as_dict(payload).select("json").collect()), "{}")}

    @_enveloped
    def summarize(self, conv_id: int) -> dict:
        return {"summary": next((r.macro for r in memory.macro(self._nodes(conv_id), self.config).collect()), "")}

    @_enveloped
    def stats(self, conv_id: int) -> dict:
        turns = self._turns(conv_id).agg(F.count("*").alias("turns"), F.coalesce(F.sum("tok"), F.lit(0)).alias("raw")).collect()[0]
        if turns.turns == 0:
            raise ValueError(f"no session {conv_id}")
        nodes = self._nodes(conv_id).agg(F.count("*").alias("n"), F.coalesce(F.sum("tok"), F.lit(0)).alias("tok")).collect()[0]
        recent = min(turns.turns, self.config.hot_turns)
        cold = self.store.read("cold").where(F.col("conv_id") == conv_id).count() > 0
        return {"turns_ingested": turns.turns, "raw_tokens": turns.raw, "hot_turns": recent, "warm_nodes": nodes.n, "cold_summary_exists": cold, "compression_ratio": round(turns.raw / max(nodes.tok + recent * 50, 1), 2)}

    def sessions(self) -> DataFrame:
        """The registry: a row for each session, is_active among its columns."""
        return self.store.read("registry").withColumn("is_active", F.col("status") == "active")

    @_enveloped
    def list_sessions(self, after: int | None = None, most: int = 1000) -> dict:
        """A page of the registry: the next `most` sessions behind `after`."""
        page = self.sessions() if after is None else self.sessions().where(F.col("conv_id") > after)
        return {"sessions": [r.asDict() for r in page.orderBy("conv_id").limit(most).collect()]}

    def _registered(self, conv_id: int) -> str | None:
        return next((r.status for r in self.store.read("registry").where(F.col("conv_id") == conv_id).collect()), None)

    def exists(self, conv_id: int) -> bool:
        return self._registered(conv_id) is not None

    def is_active(self, conv_id: int) -> bool:
        return self._registered(conv_id) == "active"

    # -- life cycle --

    @_enveloped
    def open(self, conv_id: int) -> dict:
        """Register a session, or take a closed one up again; its turns, nodes and indexes go on where they were."""
        status = self._registered(conv_id)
        if status is None:
            row = self.spark.createDataFrame([(conv_id,)], "conv_id long").select("conv_id", F.lit("active").alias("status"), F.lit(0).cast("long").alias("turn_count"), F.lit(0).cast("long").alias("done_to"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("last_active"))
            self.store.append("registry", row)
        elif status != "active":
            self._mark(self.store.read("registry").where(F.col("conv_id") == conv_id), "active")
        return {"conv_id": conv_id, "resumed": status is not None}

    def _mark(self, rows: DataFrame, status: str, done: bool = False) -> None:
        done_to = F.col("turn_count") if done else F.col("done_to")
        self.store.append("registry", rows.select("conv_id", F.lit(status).alias("status"), "turn_count", done_to.alias("done_to"), "created_at", F.current_timestamp().alias("last_active")))

    def _archive(self, sessions: DataFrame) -> None:
        """The archive rows of sessions (conv_id), from all their nodes and turns."""
        nodes, turns = (self.store.read(name).join(sessions, "conv_id", "left_semi") for name in ("nodes", "turns"))
        self.store.append("cold", memory.cold_from_nodes(nodes, turns, self.config))

    def _close(self, rows: DataFrame) -> None:
        """Close registry rows: what no node holds yet becomes nodes, summaries go to the archive."""
        turns = self.store.read("turns").join(rows.select("conv_id", "done_to"), "conv_id").where(F.col("idx") >= F.col("done_to")).drop("done_to")
        self.store.append("nodes", memory.compress(turns, self.config, vectorizer=self.vectorizer))
        self._archive(rows.select("conv_id"))
        self._mark(rows, "closed", done=True)

    @_enveloped
    def checkpoint(self, conv_id: int | None = None) -> dict:
        """Write the archive rows of a session, or of all active ones, as they are now; nothing is closed or flushed. A scheduler calls it periodically."""
        rows = self.store.read("registry").where("status = 'active'")
        self._archive((rows if conv_id is None else rows.where(F.col("conv_id") == conv_id)).select("conv_id"))
        return {"conv_id": conv_id}

    @_enveloped
    def close(self, conv_id: int) -> dict:
        """The recent turns become nodes, the session's summary goes to the archive, the registry says closed."""
        self._close(self.store.read("registry").where((F.col("conv_id") == conv_id) & (F.col("status") == "active")))
        return {"conv_id": conv_id}

    @_enveloped
    def close_all(self) -> dict:
        """Close all active sessions, in one distributed job and not one by one."""
        self._close(self.store.read("registry").where("status = 'active'"))
        return {}

    @_enveloped
    def delete(self, conv_id: int) -> dict:
        return {"deleted_nodes": self.store.delete_session(conv_id)}

    @_enveloped
    def delete_node(self, conv_id: int, node_id: str) -> dict:
        return {"deleted_nodes": self.store.delete_node(conv_id, node_id)}


def stateless_compress(spark: SparkSession, messages: list[dict], query: str, config: Config | None = None, fmt: str = "messages") -> dict:
    """One conversation compressed and searched without any table."""
    config = config or Config()
    rows = spark.createDataFrame([(0, i, m.get("role"), m.get("content") or "") for i, m in enumerate(messages)], "conv_id long, turn long, role string, text string")
    turns = src.segment(rows)
    nodes = memory.compress(turns, config)
    asked = spark.createDataFrame([(0, query)], "conv_id long, query string").withColumn("qvec", V.hashed_embedding(F.col("query"), config.dim))
    payload = context.payload(retrieval.by_cosine(nodes, asked, config.top_k), turns, config)
    stats = memory.compression_stats(turns, nodes).collect()
    if fmt == "string":
        out: object = next((r.text for r in context.as_string(payload).select("text").collect()), "")
    else:
        out = [{"role": r.role, "content": r.content} for r in context.as_messages(payload).orderBy("pos").collect()]
    return {"context": out, "stats": stats[0].asDict() if stats else {}}
