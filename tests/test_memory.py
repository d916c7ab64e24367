import random

from pyspark.sql import functions as F

from palimpsest.config import Config
from palimpsest.operators import chunking, context, memory
from palimpsest.sources import messages as src


def fold_spec(natural: set[int], n: int, most: int, least: int) -> list[int]:
    """Two plain passes: the cap, then the shortest length."""
    capped, start = [], 0
    for i in range(n):
        if i in natural or i - start >= most:
            capped.append(i)
            start = i
    out, kept = [], 0
    for b in capped:
        if b - kept >= least:
            out.append(b)
            kept = b
    return out


def test_boundary_fold(spark):
    random.seed(5)
    cases = [({1}, 12, 8, 2)] + [(set(random.sample(range(1, 30), random.randint(0, 9))), random.randint(1, 30), 6, 3) for _ in range(80)]
    for most, least in {(c[2], c[3]) for c in cases}:
        own = [c for c in cases if (c[2], c[3]) == (most, least)]
        rows = spark.createDataFrame([(i, sorted(x for x in c[0] if x < c[1]), c[1]) for i, c in enumerate(own)], "i int, nat array<long>, n long")
        got = rows.select("i", chunking.boundary_fold(F.col("nat"), F.col("n"), Config(min_turns=least, max_turns=most)).alias("b")).collect()
        for r in got:
            c = own[r.i]
            assert list(r.b) == fold_spec({x for x in c[0] if x < c[1]}, c[1], most, least)


def test_turns_are_covered_once(spark, sf):
    config = Config.small()
    turns = src.segment(src.messages(spark, sf))
    chunks = chunking.chunk(turns, config).select("conv_id", "turn_start", "turn_end", F.size("turns").alias("n")).collect()
    assert sum(r.n for r in chunks) == turns.count()
    assert all(r.turn_end - r.turn_start + 1 == r.n for r in chunks)


def test_segment_defined_cases(spark):
    rows = spark.createDataFrame([(1, 0, "User", " a "), (1, 1, None, None), (1, 2, "bot", "b"), (1, 3, "x", "  ")], "conv_id long, turn long, role string, text string")
    assert [(r.idx, r.role, r.content) for r in src.segment(rows).orderBy("idx").collect()] == [(0, "user", "a"), (1, "assistant", "b")]
    assert src.segment(rows.where("false")).count() == 0


def test_plain_text(spark):
    rows = spark.createDataFrame([(1, "User: hi\n\nAI:  yes\nplain\nother\r\nsystem:"), (2, None), (3, "")], "k long, t string")
    got = [(r.k, r.idx, r.role, r.content) for r in src.parse_plain(rows, "k", "t").orderBy("k", "idx").collect()]
    assert got == [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "plain"), (1, 3, "assistant", "other")]


def test_tiers_are_disjoint(spark, sf):
    config = Config.small()
    turns = src.segment(src.messages(spark, sf))
    hot, out = memory.hot(turns, config), memory.evicted(turns, config)
    assert hot.count() + out.count() == turns.count()
    assert hot.groupBy("conv_id").count().where(F.col("count") > config.hot_turns).count() == 0


def test_latest_and_tombstones(spark):
    log = spark.createDataFrame([("a", 1, False, 1), ("a", 2, False, 2), ("b", 1, False, 3), ("b", 2, True, 3)], "k string, version long, deleted boolean, v long")
    assert [(r.k, r.v) for r in memory.latest(log, ["k"]).collect()] == [("a", 2)]


def test_micro_summaries_stay_short(spark, sf):
    from palimpsest.functions import text as X

    config = Config.small()
    turns = src.segment(src.messages(spark, sf)).select(X.token_count(memory.micro(F.col("content"), F.col("tok"), config)).alias("t"))
    assert turns.agg(F.max("t")).collect()[0][0] <= config.micro_tokens + 10


def test_payload_budget_and_micro_lines(spark, sf):
    from palimpsest.operators import retrieval

    config = Config.small()
    turns = src.segment(src.messages(spark, sf))
    ranked = retrieval.by_cosine(memory.compress(turns, config), retrieval.session_queries(turns, config), config.top_k)
    first = context.as_messages(context.payload(ranked, turns, config)).where("pos = 0").collect()
    assert first and all(r.role == "system" for r in first)
    with_micro = context.blocks(ranked, include_micro=True).select("block").collect()
    assert any("\n  - " in r.block for r in with_micro)


def test_turns_are_embedded_and_summarised_in_python(spark, sf):
    """Neither words' hashes nor summaries are interpreted lambdas, and a second version is read from the store and not computed anew."""
    from palimpsest.plans import queries
    from palimpsest.sources.store import Store

    for name in ("node_json_roundtrip", "cold_index", "cold_from_nodes", "cold_delete", "stateless_context"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in plan and "md5(" not in plan
    written, real = [], Store.append
    try:
        Store.append = lambda self, name, rows, *a, **b: (written.append(rows._jdf.queryExecution().optimizedPlan().toString()), real(self, name, rows, *a, **b))[1]
        queries.QUERIES["cold_latest"](spark, sf)
    finally:
        Store.append = real
    assert "ArrowEvalPython" in written[0] and "ArrowEvalPython" not in written[1]
