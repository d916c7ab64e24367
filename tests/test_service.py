from pyspark.sql import functions as F

from palimpsest.config import Config
from palimpsest.operators import memory
from palimpsest.session import Sessions, stateless_compress
from palimpsest.sources import messages as src
from palimpsest.streaming.hot_tier import evictions

TALK = [{"role": "user" if i % 2 == 0 else "assistant", "content": f"message number {i} about gardens, roses and rivers."} for i in range(7)]


def test_session_life(spark, tmp_path):
    s = Sessions(spark, str(tmp_path / "memory"), Config.small())
    assert s.stats(1)["status"] == "error"
    assert s.ingest_history(1, TALK)["ingested"] == 7
    assert s.ingest_turn(1, "user", "one more on gardens")["status"] == "ok"
    stats = s.stats(1)
    assert (stats["turns_ingested"], stats["hot_turns"]) == (8, 4)
    covered = s.store.read("nodes").agg(F.sum(F.col("turn_end") - F.col("turn_start") + 1)).collect()[0][0]
    assert covered == 4  # each evicted turn is in one node, whatever the calls
    got = s.retrieve_context(1, "what about the gardens?", include_micro=True)
    assert got["status"] == "ok" and got["context"][0]["role"] == "system"
    assert s.close(1)["status"] == "ok"
    assert [r["status"] for r in s.list_sessions()["sessions"]] == ["closed"]
    assert s.store.read("cold").count() == 1
    assert s.delete(1)["deleted_nodes"] > 0 and s.store.read("turns").count() == 0
    assert s.ingest_history(1, [])["status"] == "error"
    assert s.ingest_turn(1, "stranger", "x")["status"] == "error"


def test_no_turn_is_compressed_twice(spark, tmp_path):
    s = Sessions(spark, str(tmp_path / "memory"), Config.small())
    say = lambda a, b: [{"role": "user", "content": f"turn {i} of roses"} for i in range(a, b)]
    assert s.open(1) == {"status": "ok", "conv_id": 1, "resumed": False} and s.exists(1) and s.is_active(1) and not s.exists(2)
    assert s.ingest_turn(1, "user", " ")["status"] == "error" and s.ingest_history(1, [])["status"] == "error"
    assert s.ingest_history(1, [*say(0, 7), {"role": "user", "content": " "}])["ingested"] == 7
    assert s.checkpoint(1)["status"] == "ok" and s.is_active(1) and s.store.read("cold").count() == 1
    s.close(1)
    assert not s.is_active(1) and s.open(1)["resumed"]
    s.ingest_history(1, say(7, 13))
    s.ingest_history(2, say(0, 3))
    s.close_all()
    held = [(r.conv_id, i) for r in s.store.read("nodes").collect() for i in range(r.turn_start, r.turn_end + 1)]
    assert sorted(held) == [(1, i) for i in range(13)] + [(2, i) for i in range(3)]
    assert [r["conv_id"] for r in s.list_sessions(after=1)["sessions"]] == [2]
    node = s.store.read("nodes").where("conv_id = 2").first().node_id
    assert s.delete_node(2, node)["deleted_nodes"] == 1 and s.store.read("nodes").where("conv_id = 2").count() == 0


def test_a_session_filters_its_scan(spark, tmp_path):
    s = Sessions(spark, str(tmp_path / "memory"), Config.small())
    s.ingest_history(1, TALK)
    plan = s._nodes(1)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(conv_id,1)" in plan


def test_a_vectorizer_of_ones_own(spark, tmp_path):
    config = Config(dim=2, max_turns=4, hot_turns=2)
    length = lambda text: F.array(F.length(text).cast("double"), F.lit(1.0))
    s = Sessions(spark, str(tmp_path / "memory"), config, vectorizer=length)
    s.ingest_history(1, TALK)
    assert all(len(r.vec) == 2 for r in s.store.read("nodes").collect())
    assert s.retrieve_context(1, "roses")["status"] == "ok"


def test_stateless(spark):
    out = stateless_compress(spark, TALK, "roses", Config.small())
    assert out["stats"]["turns"] == 7 and out["context"][0]["role"] == "system"


def test_stream_evicts_what_the_batch_does(spark, sf, tmp_path):
    config = Config.small()
    turns = src.segment(src.messages(spark, sf))
    schema = turns.schema
    for part in range(2):  # two micro-batches, later turns in the second
        turns.where(F.col("idx") % 8 >= 4 if part else F.col("idx") % 8 < 4).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = evictions(stream, config).writeStream.outputMode("update").format("memory").queryName("evicted").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.conv_id, r.idx) for r in spark.table("evicted").collect())
    assert got == sorted((r.conv_id, r.idx) for r in memory.evicted(turns, config).collect())
