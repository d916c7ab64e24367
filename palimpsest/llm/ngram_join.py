"""Exact Jaccard join of word n-gram sets with a token-group matrix.

1. Every text becomes the set of its distinct shingles; equal sets are one node (a 64-bit hash of the set).
2. A first pass counts shingles into a broadcast table of fixed size: not met twice, or met often to one of three degrees. All sets are ordered alike, rare
   shingles first (degree, then hash). Two sets of similarity PERCENT share PERCENT of the larger one's shingles or more, so each has one of the shared ones among
   its first n - ceil(n * PERCENT / 100) + 1, whatever else is in them. Those of a set that may stand in another one are sent; a text that has enough words
   of its own sends nothing. Nodes that share a sent shingle with a shingle's smallest node are neighbours: linked nodes always end up in one cluster.
   They meet only in the same or the next size class (a class spans PERCENT), as linked sets do: else chains of strangers of all sizes become one cluster.
   A task's step joins its own nodes first, so a shingle is sent twice a step and size class, however many copies there are.
3. Clusters of neighbours (connected components) are cut into tiles of bounded size. Every tile meets itself and the cluster's first tile. Where a cluster has more
   than two tiles, the nodes that these meetings have not joined to its heaviest group meet all other tiles; nodes of one group need no further meeting,
   so a cluster of near copies costs its size and not its square. In a meeting, nodes are put into groups of similar ones. A token-group matrix holds the
   union of each group's shingles; a node's overlap with the union bounds its overlap with every member, and only groups whose bound reaches the needed
   overlap are opened. In an opened group, members that the node isn't connected with already are compared exactly.
4. Components of the verified links give each row its class.

Words: `[^\\x20\\x09-\\x0D]+` of the text with A-Z lowered. Fewer words than a shingle has: the whole sequence is the one shingle. No words, null or
empty text: an empty set, linked with nothing, its own component. Repeated rows and doc_ids: rows are nodes' members, a doc_id is only a
name; null doc_ids take part and are never a component's name unless all its rows are null. Very long texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, documents, in_values, key_bits, lean, level_table, levels_of, mix, packed_keys, runs_of, shingles, staged, staged_at, steps, table_bits, text_bytes, unstage, value_table
from .graph import components

#: Shingles in a tile; groups in a tile's matrix; text bytes of a step.
TILE_TOKENS, GROUPS, STEP = 1 << 19, 64, 2 << 20


def shingle_sets(array: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offs = text_bytes(array)
    words = Words(raw, offs)
    hashes = words.hashes(lower=True)
    runs, first = shingles(hashes, words.first, width)
    out = []
    for k, n in enumerate(words.counts.tolist()):
        if n >= width:
            out.append(np.unique(runs[first[k] : first[k + 1]]))
        elif n:
            h = hashes[words.first[k] : words.first[k + 1]]
            out.append(mix(shingles(h, np.array([0, n]), n)[0], 77))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(tokens: np.ndarray) -> int:
    return int(mix(np.array([mix(tokens, 11).sum(dtype=np.uint64)]) + np.uint64(len(tokens)), 12).view(np.int64)[0])


def _members(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=STEP):
            sets = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n_shingles", "node"])

    return run


def _nodes(batches: Iterator[pa.RecordBatch], width: int, first) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, their sizes, all their shingles) of each step, from the rows that stand for their nodes; copies of a node in a step are one."""
    for batch in steps(batches, most=STEP):
        sets = shingle_sets(batch.column("text"), width)
        nodes = np.array([node_of(s) if len(s) else 0 for s in sets], np.int64)
        stands = in_values(first, nodes, batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
        held = {int(nodes[k]): sets[k] for k in np.flatnonzero(stands).tolist() if len(sets[k])}
        if held:
            yield np.array(list(held), np.int64), np.array([len(s) for s in held.values()], np.int64), np.concatenate(list(held.values()))


def _counted(width: int, bits: int, first):
    """First pass: each step's shingles by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, tokens in _nodes(batches, width, first):
            key, count = np.unique(tokens >> np.uint64(64 - bits), return_counts=True)
            yield packed_keys(key, count > 1)

    return run


def prefixes(sizes: np.ndarray, tokens: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """Places in `tokens` of the shingles by which sets of these sizes can meet a linked one: the rarest ones of each, without those that no other set has."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((tokens, levels, owner))
    rank = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    most = sizes - (sizes * percent + 99) // 100 + 1
    first = order[rank < most[owner]]
    return first[levels[first] > 0]


def size_class(sizes: np.ndarray, percent: int) -> np.ndarray:
    """A class of each size: sizes of which one is `percent` of the other or more are in the same class or in neighbouring ones. The slack is far above a logarithm's error."""
    return np.floor(np.log(sizes) / max(np.log(100 / percent) * (1 + 1e-9), 1e-12)).astype(np.int64)


def meeting_keys(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Two keys of each shingle of a set of that class, first all of one kind: sets meet by a shingle if their classes are equal or neighbours."""
    c = classes.astype(np.uint64)
    return np.concatenate([mix(tokens + mix(c, 21), 22), mix(tokens + mix(c + np.uint64(1), 21), 22)])


SENT = "is_edge boolean, token long, node long, lead long"


def _sender(width: int, percent: int, table, first):
    """Second pass: each step's rare shingles, by size class, with their smallest node of the step, and the edges from the other nodes to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sizes, tokens in _nodes(batches, width, first):
            at = prefixes(sizes, tokens, levels_of(table, tokens), percent)
            if len(at) == 0:
                continue
            of = np.repeat(np.arange(len(nodes)), sizes)[at]
            keys, owner = meeting_keys(tokens[at], size_class(sizes, percent)[of]), np.tile(nodes[of], 2)
            order = np.lexsort((owner, keys))
            token, begins, ends = runs_of(keys[order])
            owner = owner[order]
            lead = np.repeat(owner[begins], ends - begins)
            pairs = np.unique(np.stack([owner, lead], 1)[owner != lead], axis=0)
            n, m = len(token), len(pairs)
            none = np.zeros(m, np.int64)
            columns = [pa.array(np.repeat([False, True], [n, m])), pa.array(np.concatenate([token.view(np.int64), none])), pa.array(np.concatenate([owner[begins], pairs[:, 0]])), pa.array(np.concatenate([owner[begins], pairs[:, 1]]))]
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in SENT.split(", ")])

    return run


def _texts(width: int, wanted):
    """A text of each wanted node of a step, from the rows that stand for their nodes: copies send none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=STEP):
            sets = shingle_sets(batch.column("text"), width)
            nodes = np.array([node_of(s) if len(s) else 0 for s in sets], np.int64)
            stands = in_values(wanted, nodes, batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
            held = {int(nodes[k]): k for k in np.flatnonzero(stands).tolist() if len(sets[k])}
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), batch.column("text").take(pa.array(list(held.values()), pa.int64()))], ["node", "text"])

    return run


def link_tile(sets: list[np.ndarray], side: np.ndarray, percent: int, groups: int = GROUPS) -> list[tuple[int, int]]:
    """Links that connect everything that is connected by links across `side` 0 and 1 (or within 2), found with a token-group matrix.

    side: of each set, 0 or 1 where two tiles meet (pairs within a side are another task's), 2 in a tile that meets itself.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(-sizes, kind="stable")
    vocabulary, local = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    tokens = [local[cuts[k] : cuts[k + 1]] for k in range(n)]
    matrix = np.zeros((groups, len(vocabulary)), bool)
    member: list[list[int]] = []
    smallest = np.zeros(groups, np.int64)
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    mask = np.zeros(len(vocabulary), bool)
    for k in order.tolist():
        own, size = tokens[k], int(sizes[k])
        bound = matrix[: len(member), own].sum(1) if member else np.zeros(0, np.int64)
        # 100 * both >= percent * (size + other - both)
        may = bound * (100 + percent) >= percent * (size + smallest[: len(member)])
        mask[own] = True
        for g in np.flatnonzero(may)[np.argsort(-bound[may], kind="stable")].tolist():
            waiting = [m for m in member[g] if side[m] + side[k] in (1, 4) and root(m) != root(k) and size * 100 >= percent * sizes[m]]
            for a in range(0, len(waiting), 32):
                some = [m for m in waiting[a : a + 32] if root(m) != root(k)]
                if not some:
                    continue
                ends = np.cumsum(sizes[some])
                both = np.diff(np.concatenate([[0], np.cumsum(mask[np.concatenate([tokens[m] for m in some])])[ends - 1]]))
                for m, b in zip(some, both.tolist(), strict=True):
                    if 100 * b >= percent * (size + int(sizes[m]) - b) and root(m) != root(k):
                        parent[root(m)] = root(k)
                        out.append((k, m))
        mask[own] = False
        if len(member) and (bound.max() * 2 >= size or len(member) == groups):
            g = int(bound.argmax())
            smallest[g] = min(smallest[g], size)
        else:
            g = len(member)
            member.append([])
            smallest[g] = size
        member[g].append(k)
        matrix[g, own] = True
    return out


def _verify(width: int, percent: int):
    """The links of a meeting; rows have a side, see link_tile."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        nodes, sides, sets = [], [], []
        for batch in steps(iter(table.select(["node", "side", "text"]).to_batches()), most=STEP):
            nodes += batch.column("node").to_pylist()
            sides += batch.column("side").to_pylist()
            sets += shingle_sets(batch.column("text"), width)
        links = link_tile(sets, np.array(sides), percent) if len(nodes) > 1 else []
        return pa.table({"a": pa.array([nodes[i] for i, _ in links], pa.int64()), "b": pa.array([nodes[j] for _, j in links], pa.int64())})

    return run


def candidate_clusters(docs: DataFrame, names: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component): nodes that could be linked with another one, and their cluster."""
    total, count = names.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).collect()[0]
    bits = key_bits(total)
    # The row with the smallest doc_id stands for its node: copies neither count as sightings nor send anything. A false hit only adds a row.
    first = value_table(names.select("node", "name"), count)
    table = level_table(docs.mapInArrow(lean(_counted(width, bits, first)), "bucket int, packed binary"), bits, table_bits(total))
    sent = staged(docs.mapInArrow(lean(_sender(width, percent, table, first)), SENT), "ngram-sent")
    first.destroy()
    table.destroy()
    tokens = sent.where("not is_edge").select("token", "node")
    # A shingle comes twice a step and size class at most, so its rows stay few even where a third of all texts share it.
    lead = tokens.groupBy("token").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("token", "lead")
    met = tokens.join(lead, "token").select("node", "lead")
    return components(met.unionByName(sent.where("is_edge").select("node", "lead")).select(F.col("node").alias("a"), F.col("lead").alias("b")))


def _links(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) of each row, (node, name, n) of each node, and (node, component) of the nodes that have a link."""
    docs = documents(docs)
    members = staged(docs.mapInArrow(lean(_members(width)), "doc_id long, n_shingles long, node long"), "ngram-members")
    names = members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("name"), F.max("n_shingles").alias("n"))
    placed = staged(candidate_clusters(docs, names, width, percent).join(names, "node"), "ngram-clusters")
    wanted = value_table(placed.select("node", "name"), placed.count())
    weight = placed.groupBy("component").agg(F.sum("n").alias("tokens"))
    placed = placed.hint("merge").join(weight, "component").withColumn("tiles", F.ceil(F.col("tokens") / TILE_TOKENS).cast("int"))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).select("component", "node", "n", "tile", "tiles")
    texts = docs.mapInArrow(lean(_texts(width, wanted)), "node long, text string").dropDuplicates(["node"])
    # A merge join at every size: the clusters grow with the input, so they are never broadcast.
    held, held_path = staged_at(placed.hint("merge").join(texts, "node"), "ngram-texts")
    wanted.destroy()
    # A tile meets itself and the first one, which meets all.
    t, first = F.col("tile"), F.lit(0)
    itself = F.struct(t.alias("i"), t.alias("j"), F.lit(2).alias("side"))
    others = F.when(t > 0, F.array(F.struct(first.alias("i"), t.alias("j"), F.lit(1).alias("side")))).when(F.col("tiles") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.col("tiles") - 1, F.lit(1))), lambda j: F.struct(first.alias("i"), j.alias("j"), F.lit(0).alias("side"))))
    none = F.expr("array_repeat(named_struct('i', 0, 'j', 0, 'side', 0), 0)")
    met = held.select("component", "node", "text", F.explode(F.concat(F.array(itself), F.coalesce(others, none))).alias("m")).select("component", "node", "text", "m.i", "m.j", "m.side")
    links = staged(met.groupBy("component", "i", "j").applyInArrow(_verify(width, percent), "a long, b long"), "ngram-links")
    linked = components(links)
    if held.where("tiles > 2").limit(1).count():
        large = held.where("tiles > 2").drop("text").join(linked.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        heavy = large.groupBy("component", "label").agg(F.sum("n").alias("weight")).groupBy("component").agg(F.max_by("label", F.struct("weight", "label")).alias("heavy"))
        apart = large.join(heavy, "component").where("label <> heavy and tile > 0").select("component", "node", "tile", "tiles")
        apart = staged(apart, "ngram-apart")
        # What is apart meets all tiles but the first and its own.
        wide = apart.join(held.select("node", "text"), "node").select("component", "node", "text", F.col("tile").alias("i"), F.explode(F.sequence(F.lit(1), F.col("tiles") - 1)).alias("j"), F.lit(1).alias("side")).where("i <> j")
        tiles = apart.select("component", F.col("tile").alias("i")).distinct()
        against = held.where("tiles > 2 and tile > 0").select("component", "node", "text", F.col("tile").alias("j")).join(tiles.hint("merge"), "component").where("i <> j").select("component", "node", "text", "i", "j", F.lit(0).alias("side"))
        more = wide.unionByName(against).groupBy("component", "i", "j").applyInArrow(_verify(width, percent), "a long, b long")
        linked = components(links.unionByName(more))
    unstage(docs.sparkSession, held_path)
    return members, names, linked


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, node) for each row: component_id is the smallest doc_id that links reach, node the row's shingle set."""
    members, names, linked = _links(docs, width, percent)
    named = names.join(linked, "node", "left").select("node", "name", F.coalesce("component", "node").alias("component"))
    best = named.groupBy("component").agg(F.min("name").alias("component_id"))
    of_node = named.join(best, "component").select("node", "component_id")
    out = members.join(of_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group, all its columns as they are.

    The row with the smallest doc_id stays (null last, then by a hash of text and of the row). A row without words is a group of its own; only equal
    doc_ids and texts among those become one.
    """
    _, names, linked = _links(docs, width, percent)
    joined = linked.join(names, "node")
    chosen = joined.groupBy("component").agg(F.min(F.struct(F.col("name").isNull().alias("nameless"), "name", "node"))["node"].alias("chosen"))
    losers = joined.join(chosen, "component").where("node <> chosen").select(F.col("node").alias("loser"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=STEP):
            nodes = [node_of(s) if len(s) else None for s in shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column("doc_id"), batch.column("text"), batch.column("whole")], ["node", "doc_id", "text", "whole"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    documents(docs)  # small Arrow batches
    rows = plain.mapInArrow(lean(keyed), f"node long, doc_id long, text string, whole {plain.schema['whole'].dataType.simpleString()}")
    rows = rows.select(F.coalesce("node", F.xxhash64("doc_id", "text")).alias("key"), F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64("text").alias("t"), F.xxhash64("whole").alias("w")).alias("order"), "whole")
    # Copies become one before the shuffle; the losers go by the same key after it.
    one = rows.groupBy("key").agg(F.min_by("whole", "order").alias("whole"))
    return one.join(losers.hint("merge"), F.col("key") == F.col("loser"), "left_anti").select("whole.*")


def oracle_sql(width: int = 3, percent: int = 90) -> str:
    """Classes from the overlaps of all pairs of distinct shingle sets, for small tables."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= {width} THEN list_sort(list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: {shingle})))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
c AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
t AS (SELECT node, n, unnest(s) AS t FROM c),
l AS (SELECT a.node AS a, b.node AS b FROM t a JOIN t b ON a.t = b.t AND a.node < b.node WHERE 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT node AS a, node AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS node, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m ON c.node = m.node"""
