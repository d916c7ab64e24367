"""The recent tier as keyed state: each session keeps its last turns, and a turn that leaves them is emitted once.

Batch counterpart: `memory.evicted`. Turns of a micro-batch are ordered by index inside the handler, since arrival order within a batch is not fixed; a batch
whose turns come before turns that an earlier batch has already evicted keeps them all the same, as late turns are never dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Config
from ..operators import memory
from ..operators.chunking import Vectorizer

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "conv_id long, idx long, role string, content string, tok long, turns long, raw_tokens long"


class HotTier(StatefulProcessor):
    """List state of at most `limit` turns, and running counts of a session's turns and tokens."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("recent", "idx long, role string, content string, tok long")
        self.counts = handle.getValueState("counts", "turns long, raw_tokens long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = [tuple(r) for chunk in rows for r in chunk[["idx", "role", "content", "tok"]].itertuples(index=False)]
        turns, tokens = (int(x) for x in self.counts.get()) if self.counts.exists() else (0, 0)
        turns, tokens = turns + len(arrived), tokens + sum(int(r[3]) for r in arrived)
        held = sorted([*(tuple(r) for r in self.buffer.get()), *arrived], key=lambda r: int(r[0]))
        out, kept = held[: max(len(held) - self.limit, 0)], held[max(len(held) - self.limit, 0) :]
        self.buffer.put([(int(i), r, c, int(t)) for i, r, c, t in kept])
        self.counts.update((turns, tokens))
        if out:
            yield pd.DataFrame([(int(key[0]), int(i), r, c, int(t), turns, tokens) for i, r, c, t in out], columns=["conv_id", "idx", "role", "content", "tok", "turns", "raw_tokens"])

    def close(self) -> None:
        pass


def evictions(turns: DataFrame, config: Config) -> DataFrame:
    """Streaming turns (conv_id, idx, role, content, tok) -> the turns that leave their session's recent tier."""
    return turns.groupBy("conv_id").transformWithStateInPandas(HotTier(config.hot_turns), EVENTS, "update", "none")


def compress_evictions(turns: DataFrame, config: Config, write: Callable[[DataFrame, int], None], checkpoint: str, vectorizer: Vectorizer | None = None):
    """Start a query that turns each micro-batch's evictions into memory nodes, each evicted turn a node, and hands them to `write` with the batch number."""

    def batch(rows: DataFrame, number: int) -> None:
        nodes = memory.compress(rows.select("conv_id", "idx", "role", "content", "tok"), config, single=True, vectorizer=vectorizer)
        write(nodes, number)

    return evictions(turns, config).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def session_counts(turns: DataFrame) -> DataFrame:
    """Running turns and tokens of each session, for update mode."""
    from pyspark.sql import functions as F

    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("tok").alias("raw_tokens"), F.max("idx").alias("last_idx"))
