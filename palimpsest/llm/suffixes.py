"""Exact substring dedup over suffix-array shards built by external induced sorting.

Which bytes go: each byte covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id.

1. Every window of LENGTH bytes has a minimizer, the smallest hash of the GRAM-byte strings in it; consecutive windows with one minimizer are a run.
   Equal windows have equal minimizers, so all occurrences of a string meet in the shard of its minimizer. A first pass finds minimizers that stand in more
   than one document and sets their bits in a table of fixed size; a second pass sends only runs whose bit is set. A false hit costs bytes, never a result.
2. Runs of one content in one step of a task are sent once, for the smallest document; the others lose their windows on the spot. A passage that a third of
   all documents share is sent once a step.
3. A shard's pieces are laid end to end and their suffixes are sorted by induction: substrings between left-most S-type places are sorted by an induced pass and named, the names'
   suffixes are sorted in turn (names cover two bytes or more, so LENGTH bytes bound the depth), and all suffixes are induced from them. Suffix tuples wait in a
   queue by first byte, the induction's priority, whose overflow goes to the executor's disk. Common prefixes of neighbours, up to LENGTH, then cut the order into groups of equal windows.

Null, empty or shorter texts lose nothing. Null doc_ids come first and count as one document, as do rows with equal doc_ids; rows are told apart by their text's
hash. Repeated rows get equal results. Texts of any length are whole: long ones are cut into overlapping segments for the scan alone.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, in_table, key_bits, lean, mix, packed_keys, prefix_hash, runs_of, shared_table, span_hash, steps, table_bits, text_bytes

#: Bytes of a repeated string; bytes of a gram; text bytes of a shard, of a step and of a segment of a long text;
#: suffixes that a queue keeps in memory.
LENGTH, GRAM, SHARD_BYTES, STEP, SEGMENT, QUEUE_ITEMS = 50, 16, 2 << 20, 2 << 20, 4 << 20, 1 << 24


class BucketQueue:
    """Arrays of suffixes by first symbol, first in first out; beyond `most` items the waiting arrays move to a file of their own on disk."""

    def __init__(self, symbols: int, most: int = QUEUE_ITEMS) -> None:
        self.waiting: list[list] = [[] for _ in range(symbols)]
        self.most, self.held = most, 0
        self.folder: tempfile.TemporaryDirectory | None = None
        self.files = 0

    def push(self, symbols: np.ndarray, items: np.ndarray) -> None:
        if len(items) == 0:
            return
        order = np.argsort(symbols, kind="stable")
        symbols, items = symbols[order], items[order]
        cuts = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist()]
        for a, b in zip(cuts, [*cuts[1:], len(items)], strict=True):
            self.waiting[int(symbols[a])].append(items[a:b])
        self.held += len(items)
        if self.held > self.most:
            self._spill()

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="induced-")
        path = os.path.join(self.folder.name, f"{self.files}.bin")
        self.files += 1
        with open(path, "wb") as out:
            at = 0
            for parts in self.waiting:
                for k, part in enumerate(parts):
                    if isinstance(part, np.ndarray):
                        data = np.ascontiguousarray(part, np.int64)
                        out.write(data.tobytes())
                        parts[k] = (path, at, len(data))
                        at += 8 * len(data)
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray:
        parts, self.waiting[symbol] = self.waiting[symbol], []
        out = []
        for part in parts:
            if isinstance(part, tuple):
                out.append(np.fromfile(part[0], np.int64, part[2], offset=part[1]))
            else:
                self.held -= len(part)
                out.append(part)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is S-type; the last place is."""
    up = np.ones(len(s), np.int8)
    up[:-1] = np.sign(s[1:].astype(np.int32) - s[:-1])
    # A run of equal symbols has the type of the step behind it.
    at = np.where(up != 0, np.arange(len(s)), len(s))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return up[at] > 0


def _induce(s: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, symbols: int, most: int) -> np.ndarray:
    """All suffixes in the order that the ordered left-most S-type places `seeds` induce."""
    ranks = s[seeds]
    order = np.argsort(ranks, kind="stable")
    seeds, ranks = seeds[order], ranks[order]
    cuts = np.searchsorted(ranks, np.arange(symbols + 1))
    # The symbol before each place if the suffix there is of the larger or of the smaller type, else -1.
    larger, smaller = np.full(len(s), -1, s.dtype), np.full(len(s), -1, s.dtype)
    larger[1:] = np.where(s_type[:-1], -1, s[:-1])
    smaller[1:] = np.where(s_type[:-1] & (s[:-1] > 0), s[:-1], -1)
    lower: list[np.ndarray] = []
    queue = BucketQueue(symbols, most)
    try:
        for c in range(symbols):
            own = []
            now = queue.pop(c)
            while len(now):
                own.append(now)
                first = larger[now]
                go = first > c
                queue.push(first[go], now[go] - 1)
                now = now[first == c] - 1
            lower.append(np.concatenate(own) if own else np.zeros(0, np.int64))
            seed = seeds[cuts[c] : cuts[c + 1]]
            first = larger[seed]
            queue.push(first[first >= 0], seed[first >= 0] - 1)
    finally:
        queue.close()
    upper: list[np.ndarray] = [np.zeros(0, np.int64)] * symbols
    queue = BucketQueue(symbols, most)
    try:
        for c in range(symbols - 1, -1, -1):
            own = []
            now = queue.pop(c)
            if c == 0:  # separators: each is the smallest suffix of its piece, in order of their seeds
                now = seeds[cuts[0] : cuts[1]][::-1]
                own.append(now)
                upper[0] = now
                break
            while len(now):
                own.append(now)
                first = smaller[now]
                go = (first < c) & (first > 0)
                queue.push(first[go], now[go] - 1)
                now = now[first == c] - 1
            upper[c] = np.concatenate(own) if own else np.zeros(0, np.int64)
            down = lower[c][::-1]
            first = smaller[down]
            queue.push(first[first > 0], down[first > 0] - 1)
    finally:
        queue.close()
    return np.concatenate([x for c in range(symbols) for x in (lower[c], upper[c][::-1])])


def sort_suffixes(s: np.ndarray, depth: int, most: int = QUEUE_ITEMS) -> np.ndarray:
    """Places of s in the order of their suffixes, exact to `depth` symbols. s holds values up to 256; 0 separates pieces and ends s."""
    n = len(s)
    s_type = _types(s)
    s_type[s == 0] = True  # a separator is smaller than all that follows or precedes it
    is_seed = s == 0
    is_seed[1:] |= s_type[1:] & ~s_type[:-1]
    seeds = np.flatnonzero(is_seed)
    # Substrings from one seed to the next, sorted by an induced pass and named by comparison with the neighbour.
    order = _induce(s, s_type, seeds, 257, most)
    found = order[is_seed[order]]
    place = np.zeros(n, np.int64)
    place[seeds] = np.arange(len(seeds))
    ends = np.append(seeds[1:], n - 1)
    size = np.minimum(ends - seeds + 1, depth)
    size[s[seeds] == 0] = 1
    own = size[place[found]]
    same = np.zeros(len(found), bool)
    same[1:] = own[1:] == own[:-1]
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = s[found[live] + k] == s[found[live - 1] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal]
        live = live[own[live] > k]
    # The names' suffixes: ranks of doubled length until they are told apart or deep enough. A rank is one more than the number of smaller suffixes, so those
    # that nothing equals keep theirs and only the others are sorted again.
    heads = np.flatnonzero(~same)
    rank = np.zeros(len(seeds), np.int64)
    rank[place[found]] = heads[np.cumsum(~same) - 1] + 1
    tied = np.sort(place[found[same | np.append(same[1:], False)]])
    width = 1
    while width * 2 - 1 < depth + 2 and len(tied):
        behind = np.where(tied + width < len(rank), rank[np.minimum(tied + width, len(rank) - 1)], 0)
        pair = rank[tied] * (len(rank) + 1) + behind
        order = np.argsort(pair)
        tied, pair = tied[order], pair[order]
        old, at = rank[tied], np.arange(len(tied))
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        equal = np.append(False, pair[1:] == pair[:-1])
        rank[tied] = old + np.maximum.accumulate(np.where(equal, 0, at)) - group
        tied = np.sort(tied[equal | np.append(equal[1:], False)])
        width *= 2
    # What is still equal stands in any order behind its rank.
    tied = tied[np.argsort(rank[tied], kind="stable")]
    old, at = rank[tied], np.arange(len(tied))
    rank[tied] += at - np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1])[: len(old)], at, 0)) if len(tied) else 0
    ordered = np.zeros(len(seeds), np.int64)
    ordered[rank - 1] = seeds
    return _induce(s, s_type, ordered, 257, most)


def equal_groups(s: np.ndarray, length: int, starts: np.ndarray, most: int = QUEUE_ITEMS) -> tuple[np.ndarray, np.ndarray]:
    """Valid window starts in suffix order, and True where one begins another group of equal windows."""
    order = sort_suffixes(s, length, most)
    valid = np.zeros(len(s), bool)
    valid[starts] = True
    order = order[valid[order]]
    raw = np.concatenate([s.astype(np.uint8), np.zeros(8, np.uint8)])  # valid windows hold no separator, so the low byte tells symbols 1..256 apart
    word = np.ndarray(len(s), "<u8", raw, strides=(1,)).copy()
    new = np.ones(len(order), bool)
    live = np.arange(1, len(order))
    for k in sorted({*range(0, length - 7, 8), max(length - 8, 0)}):
        live = live[word[order[live] + k] == word[order[live - 1] + k]]
    new[live] = False
    return order, new


def _grams(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings of 16 bytes (GRAM) that start at each place of raw."""
    x = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    out = x[:-8] * np.uint64(0x94D049BB133111EB)
    out += x[8:]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


#: Windows whose minimizers are looked for at once, so that the arrays stay in a core's cache.
BLOCK = 1 << 15


def _runs(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, minimizer) of each run of a step. Places are those in raw."""
    n = len(raw) - LENGTH + 1
    raw = np.ascontiguousarray(raw)
    begins = offs[:-1][np.diff(offs) >= LENGTH]
    at, key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    span, rest, last = LENGTH - GRAM + 1, np.uint64((1 << 24) - 1), None
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        gram = _grams(raw[a : b + LENGTH - 1])
        # The smallest hash, and the first of its places, in each window's grams.
        low = (gram & ~rest) | np.arange(a, a + len(gram), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :]) if span > width else low
        head = np.ones(len(low), bool)
        np.not_equal(low[1:], low[:-1], out=head[1:])
        head[0] = low[0] != last
        last = low[-1]
        head[begins[np.searchsorted(begins, a) : np.searchsorted(begins, b)] - a] = True
        heads = np.flatnonzero(head)
        at.append(heads + a)
        key.append(gram[(low[heads] & rest).astype(np.int64) - a])
    at, gram = np.concatenate(at), np.concatenate(key)
    text = np.searchsorted(offs, at, "right") - 1
    end = offs[1:][text] - LENGTH + 1
    count = np.minimum(np.append(at[1:], max(n, 0))[: len(at)], end) - at
    own = np.flatnonzero(at < end)
    return text[own], at[own], count[own], mix(gram[own], 91)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Steps as (raw, offsets, doc, row hash, base): texts, or overlapping segments of long ones with the place where they begin."""
    least = np.iinfo(np.int64).min
    for batch in steps(batches, most=STEP):
        raw, offs = text_bytes(batch.column("text"))
        doc = batch.column("doc_id").fill_null(least).to_numpy(zero_copy_only=False).astype(np.int64)
        row = batch.column("row").to_numpy(zero_copy_only=False).astype(np.int64)
        if len(raw) <= 2 * SEGMENT:
            yield raw, offs, doc, row, np.zeros(len(doc), np.int64)
            continue
        for k in range(len(doc)):
            for a in range(int(offs[k]), max(int(offs[k + 1]) - LENGTH + 1, int(offs[k]) + 1), SEGMENT):
                b = min(a + SEGMENT + LENGTH - 1, int(offs[k + 1]))
                yield raw[a:b], np.array([0, b - a]), doc[k : k + 1], row[k : k + 1], np.array([a - offs[k]])


def _sharers(bits: int):
    """First pass: each step's minimizers by bucket, those of two documents of the step marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw, offs, doc, _, _ in _segments(batches):
            text, _, _, key = _runs(raw, offs)
            if len(key) == 0:
                continue
            key = key >> np.uint64(64 - bits)
            order = np.lexsort((doc[text], key))
            key, owner = key[order], doc[text][order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            shared = owner[head] != owner[np.append(head[1:], len(key)) - 1]
            key = key[head]
            yield packed_keys(key, shared)

    return run


_PIECE = np.dtype([("content", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("at", "<i4"), ("windows", "<i4")])


def _sender(bits: int, shards: int, table):
    """Second pass: for each shard of a step, its pieces and, without bytes, the spans that were decided in the step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for raw, offs, doc, row, base in _segments(batches):
            text, at, windows, key = _runs(raw, offs)
            hit = in_table(table, key)
            text, at, windows, key = text[hit], at[hit], windows[hit], key[hit]
            if len(key) == 0:
                continue
            content = mix(span_hash(prefix_hash(raw), at, at + windows + LENGTH - 1) + key, 92)
            order = np.lexsort((at, doc[text], content))
            text, at, windows, key, content = (x[order] for x in (text, at, windows, key, content))
            head = np.concatenate([[True], content[1:] != content[:-1]])
            late = doc[text] != doc[text[np.flatnonzero(head)]][np.cumsum(head) - 1]
            shard = (mix(key, 93) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            text, at, windows, late, shard, content = (x[order] for x in (text, at, windows, late, shard, content))
            full, begins, ends = runs_of(shard)
            blobs = []
            for first, last in zip(begins.tolist(), ends.tolist(), strict=True):
                pick = slice(first, last)
                piece = np.zeros(last - first, _PIECE)
                t, begin, w = text[pick], at[pick], windows[pick]
                piece["content"], piece["doc"], piece["row"], piece["at"] = content[pick], doc[t], row[t], begin - offs[t] + base[t]
                piece["windows"] = np.where(late[pick], -w, w)
                size = np.where(late[pick], 0, w + LENGTH - 1)
                total = np.cumsum(size)
                body = raw[np.repeat(begin - total + size, size) + np.arange(total[-1])]
                blobs.append(packer.compress(len(piece).to_bytes(4, "little") + piece.tobytes() + body.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "packed"])

    return run


def _joined(doc: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """(doc, row, spans): the spans [a, b) of each row of a document, joined where they touch."""
    order = np.lexsort((a, row, doc))
    doc, row, a, b = doc[order], row[order], a[order].astype(np.int64), b[order].astype(np.int64)
    new_row = np.ones(len(a), bool)
    new_row[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    group = np.cumsum(new_row) - 1
    # Rows are set apart by an offset larger than any place, so one running maximum serves all.
    apart = group * (int(b.max(initial=0)) + 2)
    top = np.maximum.accumulate(b + apart)
    head = np.ones(len(a), bool)
    head[1:] = (a + apart)[1:] > top[:-1]
    heads = np.flatnonzero(head)
    ends = top[np.append(heads[1:], len(a)) - 1] - apart[heads] if len(a) else np.zeros(0, np.int64)
    spans = np.stack([a[heads], ends], 1).astype("<i4")
    cuts = np.flatnonzero(new_row[heads])
    blobs = [spans[x:y].tobytes() for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(spans)], strict=True)] if len(cuts) else []
    return pa.table({"doc": pa.array(doc[heads][cuts]), "row": pa.array(row[heads][cuts]), "spans": pa.array(blobs, pa.binary())})


def _sort_shard(key: tuple, table: pa.Table) -> pa.Table:
    """The spans that a shard's equal windows and its decided runs take from documents."""
    import zstandard

    reader = zstandard.ZstdDecompressor()
    pieces, bodies = [], []
    for x in table.column("packed").combine_chunks():
        data = reader.decompress(x.as_buffer())
        n = int.from_bytes(data[:4], "little")
        pieces.append(np.frombuffer(data, _PIECE, n, 4))
        bodies.append(np.frombuffer(data, np.uint8, -1, 4 + n * _PIECE.itemsize))
    p, body = np.concatenate(pieces), np.concatenate(bodies)
    done = p[p["windows"] < 0]
    live = p[p["windows"] > 0]
    # Of pieces of one content only the smallest document's is sorted: the others' windows all stand in it.
    order = np.lexsort((live["doc"], live["content"]))
    head = np.concatenate([[True], live["content"][order][1:] != live["content"][order][:-1]]) if len(live) else np.zeros(0, bool)
    late = np.zeros(len(live), bool)
    late[order] = live["doc"][order] != live["doc"][order][np.flatnonzero(head)][np.cumsum(head) - 1] if len(live) else False
    done = np.concatenate([done, live[late]])
    done["windows"] = np.abs(done["windows"])
    body = body[np.repeat(~late, live["windows"] + LENGTH - 1)]
    live = live[~late]
    size = live["windows"].astype(np.int64) + LENGTH - 1
    begin = np.cumsum(size + 1) - size - 1
    s = np.zeros(int((size + 1).sum()), np.int16)
    owner = np.repeat(np.arange(len(live)), size + 1)
    inside = np.ones(len(s), bool)
    inside[begin + size] = False
    s[inside] = body.astype(np.int16) + 1
    w = live["windows"].astype(np.int64)
    starts = np.repeat(begin - np.cumsum(w) + w, w) + np.arange(int(w.sum()))
    order, new = equal_groups(s, LENGTH, starts) if len(s) else (np.zeros(0, np.int64), np.zeros(0, bool))
    doc = live["doc"][owner[order]] if len(order) else np.zeros(0, np.int64)
    heads = np.flatnonzero(new)
    low = np.minimum.reduceat(doc, heads)[np.cumsum(new) - 1] if len(heads) else doc
    gone = order[doc > low]
    own = owner[gone] if len(gone) else np.zeros(0, np.int64)
    at = live["at"][own] + (gone - begin[own])
    return _joined(
        np.concatenate([live["doc"][own], done["doc"]]), np.concatenate([live["row"][own], done["row"]]),
        np.concatenate([at, done["at"]]), np.concatenate([at + LENGTH, done["at"] + done["windows"] + LENGTH - 1]),
    )


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, most=STEP):
        raw, offs = text_bytes(batch.column("text"))
        marks = [(k, m) for k, x in enumerate(batch.column("marks").to_pylist()) for m in x or []]
        spans = np.frombuffer(b"".join(m for _, m in marks), "<i4").reshape(-1, 2).astype(np.int64)
        text = np.repeat(np.array([k for k, _ in marks], np.int64), np.array([len(m) // 8 for _, m in marks], np.int64))
        order = np.lexsort((spans[:, 0], text))
        text = text[order]
        spans = spans[order] + offs[text][:, None]
        # Spans that touch are one run; texts lie one behind the other, so one running maximum serves all.
        top = np.maximum.accumulate(spans[:, 1])
        head = np.ones(len(text), bool)
        head[1:] = (text[1:] != text[:-1]) | (spans[1:, 0] > top[:-1])
        heads = np.flatnonzero(head)
        begin, end = spans[heads, 0], top[np.append(heads[1:], len(text)) - 1] if len(heads) else heads
        cuts = np.searchsorted(text[heads], np.arange(len(offs)))
        removed = np.append(0, np.cumsum(end - begin))[cuts]
        edges, at, body, digests = list(zip(begin.tolist(), end.tolist(), strict=True)), offs.tolist(), memoryview(raw), []
        for k, (first, last) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            digest, kept = hashlib.sha256(), at[k]
            for a, b in edges[first:last]:
                digest.update(body[kept:a])
                kept = b
            digest.update(body[kept : at[k + 1]])
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offs)), pa.array(np.diff(removed)), pa.array(np.diff(cuts)), pa.array(digests, pa.string())], [c.split(" ")[0] for c in REPORT.split(", ")])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, row, spans): packed spans of bytes, as little-endian pairs of 32 bits, that go from the document's row with the text hash `row`; null doc_ids are the least long."""
    spark = docs.sparkSession
    docs = documents(docs).withColumn("row", F.xxhash64("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    bits = key_bits(total)
    table = shared_table(docs.mapInArrow(lean(_sharers(bits)), "bucket int, packed binary"), bits, table_bits(total // 8))
    shards = int(max(16, total // SHARD_BYTES))
    pieces = docs.mapInArrow(lean(_sender(bits, shards, table)), "shard int, packed binary")
    return pieces.groupBy("shard").applyInArrow(_sort_shard, "doc long, row long, spans binary")


def substring_report(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: bytes, removed bytes and spans, and the digest of the bytes that are kept."""
    marks = repeated_spans(docs).groupBy("doc", "row").agg(F.collect_list("spans").alias("marks"))
    rows = documents(docs).withColumn("row_", F.xxhash64("text")).withColumn("doc_", F.coalesce("doc_id", F.lit(-(2**63))))
    joined = rows.join(marks.hint("merge"), (F.col("doc_") == F.col("doc")) & (F.col("row_") == F.col("row")), "left")
    return joined.select("doc_id", "text", "marks").mapInArrow(_report, REPORT)


def oracle_sql() -> str:
    """The report over every 50-byte string of every text, for tables of a few MB."""
    return """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, i, array_slice(b, i, i + 49) AS s FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS lead FROM p GROUP BY s),
c AS (SELECT p.doc_id, p.i FROM p JOIN m ON p.s = m.s WHERE m.lead < p.doc_id),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM c),
r AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
t AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS z FROM t
    UNION ALL SELECT d.doc_id, coalesce(max(t.z), 1), any_value(d.n) + 1 FROM d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id),
h AS (SELECT k.doc_id, string_agg(hex(array_slice(d.b, k.a, k.z - 1)), '' ORDER BY k.a) AS kept FROM k JOIN d ON k.doc_id = d.doc_id WHERE k.z > k.a GROUP BY k.doc_id),
u AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM t GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(u.n_removed, 0)::BIGINT AS n_removed, coalesce(u.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(h.kept, ''))) AS kept_sha256
FROM d LEFT JOIN u ON d.doc_id = u.doc_id LEFT JOIN h ON d.doc_id = h.doc_id"""
