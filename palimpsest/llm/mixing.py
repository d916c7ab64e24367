"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in built-in functions only.

A source's documents stand in a fixed pseudo-random order that is cut into BLOCKS blocks (by the leading bits of the order key). The
source's target asks for `whole` full passes over its blocks and a part of one more; its block quota is exact. The
tree starts with all quotas at the root and halves the output shards: the left half's share of each quota is a draw from the
multivariate hypergeometric distribution (source by source, by the inverse of the univariate distribution function), the right half has the
rest, down to single shards. A source's permuted blocks are then dealt out in disjoint runs by those quotas, and rows of a shard are
ordered by a hash of shard, row and pass.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share the sum of all sizes; a target stops at 3 times its
source's size and the excess goes to the others by weight until none is above. The last pass takes each document, in order, that still fits:
it skips one that doesn't and goes on, by running sums over blocks and then over the documents of one block, until no document of the source is left that fits.

Null or empty text: size 0, it may be placed but takes no words. Null sources are one source. Rows with equal ids and sizes are
interchangeable. All-empty input: targets are 0. Reruns agree: every draw is a hash of fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Blocks of a source; words of a shard; levels of the tree between two deals of its nodes to tasks; seed of all draws.
BLOCKS, SHARD_WORDS, DEAL, SEED = 4096, 1 << 22, 8, 20240229
#: A source with this many documents left that may fit is settled at once.
LAST = 1024
_BITS = 60


def _log_factorial(x: Column) -> Column:
    z = x.cast("double") + 9.0  # Stirling's series, eight steps up
    low = F.lit(0.0)
    for k in range(1, 9):
        low = low + F.log(x.cast("double") + k)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) - low


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(good: Column, total: Column, drawn: Column, uniform: Column) -> Column:
    """How many of `good` among `total` are in `drawn` draws: the smallest k whose distribution function reaches `uniform`."""
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - good))
    high = F.least(good, drawn)
    start = F.struct(low.alias("k"), F.lit(0.0).alias("sum"), (_log_choose(good, low) + _log_choose(total - good, drawn - low) - _log_choose(total, drawn)).alias("log"), F.lit(False).alias("found"))

    def step(s: Column, k: Column) -> Column:
        reached = s["sum"] + F.exp(s["log"])
        found = s["found"] | (reached >= uniform) | (k >= high)
        up = ((good - k) * (drawn - k)).cast("double") / ((k + 1) * (total - good - drawn + k + 1)).cast("double")
        return F.when(s["found"], s).otherwise(F.struct(k.alias("k"), reached.alias("sum"), F.when(found, s["log"]).otherwise(s["log"] + F.log(up)).alias("log"), found.alias("found")))

    return F.aggregate(F.sequence(low, high), start, step, lambda s: s["k"])


def _uniform(*parts: Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def splitting_tree(quotas: DataFrame, levels: int) -> DataFrame:
    """(place, quota) of each source -> (shard, place, quota) of 2**levels shards; a source's quotas sum to its own."""
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("place", "quota"))).alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    for level in range(levels):
        if level and level % DEAL == 0:
            node = node.repartition("node")

        def draw(s: Column, x: Column) -> Column:
            got = F.when(s["room"] <= 0, F.lit(0).cast("long")).otherwise(hypergeometric(x["quota"], s["pool"], s["room"], _uniform(F.lit(level), F.col("node"), x["place"])))  # noqa: B023
            return F.struct((s["pool"] - x["quota"]).alias("pool"), (s["room"] - got).alias("room"), F.concat(s["out"], F.array(F.struct(x["place"].alias("place"), got.alias("quota")))).alias("out"))

        pool = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["quota"])
        # An odd block more goes to either side by a draw.
        room = F.floor(pool / 2).cast("long") + F.when((pool % 2 == 1) & (_uniform(F.lit(level), F.col("node"), F.lit("odd")) < 0.5), 1).otherwise(0).cast("long")
        empty = F.expr("array_repeat(named_struct('place', 0L, 'quota', 0L), 0)")
        left = F.aggregate("q", F.struct(pool.alias("pool"), room.alias("room"), empty.alias("out")), draw, lambda s: s["out"])
        node = node.select("node", "q", left.alias("left"))
        right = F.zip_with("q", "left", lambda x, y: F.struct(x["place"].alias("place"), (x["quota"] - y["quota"]).alias("quota")))
        node = node.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")))).alias("x")).select("x.node", "x.q")
    return node.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("shard", "x.place", "x.quota")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, size) rows -> (source, place, source_size, target): one row for each source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.select("source", "source_size", F.row_number().over(order).cast("long").alias("place"))
    by = by.withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * 3.0)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    by = by.withColumn("left", F.sum("cap").over(every) / 3.0 - F.coalesce(F.sum("cap").over(filling), none)).withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filling), none))
    by = by.withColumn("capped", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
    shared = F.sum("cap").over(every) / 3.0 - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(none)).over(every)
    open_weight = F.sum(F.when(F.col("capped"), none).otherwise(F.col("weight"))).over(every)
    return by.select("source", "place", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(shared * F.col("weight") / open_weight).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, placements): placements holds a (shard, order) for each time that the mix takes the document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, _BITS // 4), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows.withColumn("block", F.shiftright("key", _BITS - (BLOCKS.bit_length() - 1))), "mix-rows")
    by_source = staged(targets(rows), "mix-sources")
    known = by_source.select("source", "place", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"))
    known = known.withColumn("part", F.when(F.col("source_size") > 0, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0))
    # One row for each block that holds documents: BLOCKS at most for a source.
    blocks = _with_source(rows.groupBy("source", "block").agg(F.sum("size").alias("words")), known)
    before = F.coalesce(F.sum("words").over(Window.partitionBy("place").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = staged(blocks.withColumn("before", before), "mix-blocks")

    # The last pass: whole blocks while they fit, then documents of the next block while they fit.
    placed = _with_source(rows, known.drop("source_size", "target", "whole", "part")).join(blocks.select("place", "block", "before", "words", "whole", "part", "source_size", "target"), ["place", "block"])
    fits = F.col("before") + F.col("words") <= F.col("part")
    edge = (~fits) & (F.col("before") <= F.col("part"))
    inner = Window.partitionBy("place", "block", edge).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # Only the block at the edge needs its documents' running sum; the others are told apart by the window's third key and cost a sort of a block.
    placed = placed.withColumn("taken_part", fits | (edge & (F.col("before") + F.sum("size").over(inner) <= F.col("part"))))
    placed = staged(placed, "mix-placed")
    gaps = placed.groupBy("place").agg((F.max("part") - F.sum(F.when(F.col("taken_part"), F.col("size")).otherwise(0))).alias("gap"))
    small = placed.where(~F.col("taken_part") & (F.col("size") > 0)).join(gaps, "place").where(F.col("size") <= F.col("gap"))
    extra = _fillers(small.select("place", "block", "gap", F.struct("key", "doc_id", "size", "row").alias("x")))

    # Quotas, the tree, and the runs of permuted blocks.
    passes = F.when(F.col("before") <= F.col("part"), F.col("whole") + 1).otherwise(F.col("whole"))
    drawn = blocks.where(passes > 0).select("place", "block", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)).alias("pass"))
    total = by_source.agg(F.sum("source_size")).collect()[0][0] or 0
    levels = (total // SHARD_WORDS).bit_length()
    quotas = drawn.groupBy("place").agg(F.count("*").alias("quota"))
    # A row a source and shard. Written, so that the tree's expressions aren't planned and described again with each stage of the joins below.
    shares = staged(splitting_tree(quotas, levels), "mix-shares")
    end = F.sum("quota").over(Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    runs = shares.withColumn("end", end).where("quota > 0").select("place", "shard", F.explode(F.sequence(F.col("end") - F.col("quota") + 1, F.col("end"))).alias("rank"))
    order = Window.partitionBy("place").orderBy(F.xxhash64(F.lit(SEED), "place", "pass", "block"), "pass", "block")
    dealt = drawn.withColumn("rank", F.row_number().over(order).cast("long")).join(runs, ["place", "rank"])
    # A row a block: also written, which leaves two joins to the last plan.
    shards = staged(dealt.groupBy("place", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("passes")), "mix-shards")

    out = placed.join(shards, ["place", "block"], "left").join(extra.withColumn("is_extra", F.lit(True)), ["place", "row"], "left")
    extra_row = F.coalesce(F.col("is_extra"), F.lit(False))
    none = F.expr("array_repeat(named_struct('pass', 0L, 'shard', 0L), 0)")
    kept = F.filter(F.coalesce("passes", none), lambda p: (p["pass"] < F.col("whole")) | F.col("taken_part"))
    added = F.when(extra_row, F.array(F.struct(F.col("whole").alias("pass"), F.pmod(F.xxhash64(F.lit(SEED), "key"), F.lit(1 << levels)).alias("shard")))).otherwise(none)
    places = F.transform(F.concat(kept, added), lambda p: F.struct(p["shard"].alias("shard"), F.xxhash64(F.lit(SEED), p["shard"], p["pass"], F.col("key")).alias("order")))
    return out.select("doc_id", "source", "size", "source_size", "target", places.alias("placements"))


def _fillers(left: DataFrame) -> DataFrame:
    """(place, block, gap, x) documents, each of gap's size at most -> (place, row) of those that fill the gap: in x's order, each that still fits."""
    taken = []
    size = F.col("x.size")
    while True:
        left = staged(left, "mix-left")
        most = left.groupBy("place").count().agg(F.max("count")).collect()[0][0] or 0
        if most <= LAST:
            break
        # Whole blocks while they fit, then documents of the next block while they fit.
        blocks = left.groupBy("place", "block").agg(F.sum(size).alias("words"))
        order = Window.partitionBy("place").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
        rows = left.join(blocks, ["place", "block"])
        fits = F.col("before") + F.col("words") <= F.col("gap")
        edge = (~fits) & (F.col("before") <= F.col("gap"))
        inner = Window.partitionBy("place", "block", edge).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        rows = staged(rows.withColumn("taken", fits | (edge & (F.col("before") + F.sum(size).over(inner) <= F.col("gap")))).drop("before", "words"), "mix-round")
        taken.append(rows.where("taken").select("place", "x.row"))
        # What is left fits in what is left of the gap and comes after the first that didn't fit.
        done = rows.groupBy("place").agg(F.sum(F.when(F.col("taken"), size).otherwise(0)).alias("words"), F.min(F.when(~F.col("taken"), F.col("x"))).alias("stop"))
        rows = rows.where(~F.col("taken")).join(done, "place").withColumn("gap", F.col("gap") - F.col("words"))
        left = rows.where((F.col("x") > F.col("stop")) & (size <= F.col("gap"))).select("place", "block", "gap", "x")
    # LAST rows of a source at most come together here.
    filling = left.groupBy("place").agg(F.max("gap").alias("gap"), F.sort_array(F.collect_list("x")).alias("xs"))
    nothing = F.expr("array_repeat(0L, 0)")
    fill = F.aggregate("xs", F.struct(F.col("gap").alias("gap"), nothing.alias("out")), lambda s, x: F.when(x["size"] <= s["gap"], F.struct((s["gap"] - x["size"]).alias("gap"), F.concat(s["out"], F.array(x["row"])).alias("out"))).otherwise(s), lambda s: s["out"])
    out = filling.select("place", F.explode(fill).alias("row"))
    for rows in taken:
        out = out.unionByName(rows)
    return out


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's columns; null is a source of its own."""
    other = sources.withColumnRenamed("source", "source_")
    return rows.join(other, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def shards(mixed: DataFrame) -> DataFrame:
    """(shard, order, doc_id): a row for each document that the mix takes, each shard's rows in their shuffled order."""
    rows = mixed.select("doc_id", F.explode("placements").alias("p")).select("p.shard", "p.order", "doc_id")
    return rows.repartition("shard").sortWithinPartitions("shard", "order", "doc_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as often as the mix takes each, dealt to its shards and in each shard's shuffled order: rows that it leaves out go; all columns as they are."""
    # Rows with equal ids, sources and sizes are interchangeable and take the most places that one of them has.
    taken = mix(docs).where(F.size("placements") > 0).groupBy("doc_id", "source", "size").agg(F.max_by("placements", F.struct(F.size("placements"), "placements")).alias("placements"))
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("doc_id").cast("long").alias("id"), F.col("source").alias("from"), size.alias("words"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("from").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    placed = rows.join(taken.hint("merge"), same).select("whole", F.explode("placements").alias("p")).select("whole", "p.shard", "p.order")
    return placed.repartition("shard").sortWithinPartitions("shard", "order", F.xxhash64("whole")).select("whole.*")


def oracle_sql() -> str:
    """What the mix takes of each document: it doesn't depend on how the tree deals blocks to shards."""
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, {_BITS // 4}))::BIGINT AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM d GROUP BY source),
s1 AS (SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, sum(cap) OVER () / 3.0::DOUBLE AS total, coalesce(sum(cap) OVER f, 0) AS used, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS open
    FROM s1 WINDOW f AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap * open <= (total - used) * weight AS capped FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE
    (total - sum(CASE WHEN capped THEN cap ELSE 0.0::DOUBLE END) OVER ()) * weight / sum(CASE WHEN capped THEN 0.0::DOUBLE ELSE weight END) OVER () END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN target - whole * source_size ELSE 0.0::DOUBLE END AS part FROM s5),
p AS (SELECT d.doc_id, d.source, d.size, d.key, s6.source_size, s6.target, s6.whole, s6.part,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= s6.part AS fits
    FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
g AS (SELECT source, max(part) - sum(CASE WHEN fits THEN size ELSE 0 END)::DOUBLE AS gap FROM p GROUP BY source),
u0 AS (SELECT p.source, p.doc_id, p.size, p.key, g.gap FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source WHERE NOT fits AND size > 0 AND size <= gap GROUP BY ALL HAVING count(*) = 1),
l AS (SELECT source, list_reduce(list({{'key': key, 'doc_id': doc_id, 'size': size}} ORDER BY key, doc_id),
    lambda s, x: CASE WHEN x.size <= s.gap THEN {{'gap': (s.gap - x.size)::DOUBLE, 'keys': list_append(s.keys, x.key)}} ELSE s END,
    {{'gap': max(gap), 'keys': []::BIGINT[]}}).keys AS keys FROM u0 GROUP BY source),
x AS (SELECT u.source, u.doc_id, u.key FROM u0 u JOIN l ON u.source IS NOT DISTINCT FROM l.source WHERE list_contains(l.keys, u.key))
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * (p.whole + CASE WHEN p.fits OR x.key IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p LEFT JOIN x ON p.source IS NOT DISTINCT FROM x.source AND p.doc_id IS NOT DISTINCT FROM x.doc_id AND p.key = x.key"""
