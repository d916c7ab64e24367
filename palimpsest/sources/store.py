"""Memory tables on disk: the warm node log, the cold archive and the session registry, as Parquet logs with versions.

A write appends a version and never rewrites what a plan may be reading; readers see the newest version of each key. `compact` writes the newest versions to a
new folder. Every key begins with the session, so a read of one session filters its rows in the scan, before versions are compared; turns and nodes are sorted by
session within files, whose statistics then prune row groups.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.memory import latest

NODES = "node_id string, conv_id long, chunk_ord long, topic string, meso string, micros array<string>, turn_start long, turn_end long, tok long, vec array<double>"
TURNS = "conv_id long, idx long, role string, content string, tok long"
COLD = "conv_id long, macro string, node_count long, turn_count long, tok_orig long, tok_comp long, ratio double, topics string"
#: done_to: turns below this index are in nodes already.
REGISTRY = "conv_id long, status string, turn_count long, done_to long, created_at timestamp, last_active timestamp"
KEYS = {"nodes": ["conv_id", "node_id"], "cold": ["conv_id"], "registry": ["conv_id"], "turns": ["conv_id", "idx"]}
SCHEMAS = {"nodes": NODES, "cold": COLD, "registry": REGISTRY, "turns": TURNS}


class Store:
    """Versioned tables under one base path."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def log(self, name: str) -> DataFrame:
        """All versions; an empty table where nothing was written yet; any other fault is raised."""
        schema = f"{SCHEMAS[name]}, version long, deleted boolean"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        return latest(self.log(name), KEYS[name]).drop("version")

    def append(self, name: str, rows: DataFrame, deleted: bool = False, version: int | None = None) -> None:
        columns = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
        out = rows.select(*columns, F.lit(version or time.time_ns()).cast("long").alias("version"), F.lit(deleted).alias("deleted"))
        if name in ("nodes", "turns"):
            out = out.repartition("conv_id").sortWithinPartitions("conv_id")
        out.write.mode("append").parquet(f"{self.base}/{name}")

    def delete_session(self, conv_id: int) -> int:
        """Tombstones for all that a session has; the number of its nodes."""
        gone = 0
        for name in KEYS:
            rows = self.read(name).where(F.col("conv_id") == conv_id)
            if name == "nodes":
                gone = rows.count()
            self.append(name, rows, deleted=True)
        return gone

    def delete_node(self, conv_id: int, node_id: str) -> int:
        """A tombstone for one node; the number of nodes that it hides."""
        rows = self.read("nodes").where((F.col("conv_id") == conv_id) & (F.col("node_id") == node_id))
        gone = rows.count()
        self.append("nodes", rows, deleted=True)
        return gone

    def compact(self, name: str, path: str) -> None:
        self.read(name).withColumn("version", F.lit(time.time_ns())).withColumn("deleted", F.lit(False)).write.parquet(path)
