"""Near-duplicate passages across documents with compact windows.

A text is the sequence of its word shingles. For each of HASHES hash functions a Cartesian tree over the shingles' hashes gives compact windows
(l, c, r): all subsequences that start in l..c and end in c..r have the shingle at c as their min-hash. Only windows of MIN_WORDS words or
more are made, about 2n / MIN_WORDS of them, and cut to where a passage with their shingle c can lie: it begins and ends with shingles that are met
twice anywhere (a broadcast bit table), and PERCENT of it or more are such shingles; what is too short for a passage's counterpart after that goes. Windows travel by
min-hash in packed arrays; those with one min-hash meet. Windows with the same shingles are a class; each later one goes with the first of its class, whose
copy it is, and the first windows of all classes go with the first one of the min-hash. Matches of two documents are joined by their diagonal: where at
least NEEDED hash functions agree or the windows are one class, the passages are fetched and compared exactly (a pair that is one class from end to end is equal already). A passage of
the later document (larger doc_id) that has MIN_WORDS words or more and a Jaccard similarity of PERCENT or more with its counterpart in the earlier one is a near duplicate.

A second round leaves no partner out: windows that hold MIN_WORDS words or more in a row which the first round has not found are compared with the first windows
of all earlier classes of their min-hash, in tiles of bounded size. No pairs are made for it: a tile holds the windows' passages, and a late window meets those early ones
that hold one of its rarer shingles, besides the most held ones that can't make a passage similar by themselves. A matrix of its shingles tells which of these share
enough of a run, on both sides, to hold a near duplicate, and the exact comparison stops at the first that does.

Null or empty texts and texts of fewer than MIN_WORDS words hold no passage. Rows with a null doc_id are compared with nothing. Rows with equal
doc_ids are one document (never compared with each other) and each get its spans, cut to their own length. Texts of any length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, documents, give_back, in_table, in_values, key_bits, lean, lean_groups, mix, packed_keys, powers, runs_of, shared_table, shingles, span_hash, staged, staged_at, steps, table_bits, text_bytes, unstage, value_table

#: Words of a shingle and of the shortest passage; hash functions and how many must agree; similarity; widest gap inside a passage in shingles;
#: width of a diagonal band in shingles; bytes of windows in a bucket; text bytes of a step; rows of a batch.
WIDTH, MIN_WORDS, HASHES, NEEDED, PERCENT, GAP, BAND, BUCKET_BYTES, STEP, PAIRS = 5, 50, 4, 2, 80, 24, 64, 8 << 20, 2 << 20, 1 << 18
#: Windows of a min-hash in a tile of the second round, windows in one of its buckets, cells of a step of its matrix.
TILE, ROUND_BUCKET, CELLS = 4096, 1 << 14, 1 << 22
#: So many early windows are compared without a look at who holds which shingle.
FEW = 16
#: More than any sum of gains in a window.
FAR = 1 << 60

_WINDOW = np.dtype([("key", "<u8"), ("same", "<u8"), ("which", "<u1"), ("doc", "<i8"), ("l", "<i4"), ("c", "<i4"), ("r", "<i4")])


def sequences(array: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, the offsets of the texts among them, and each text's words."""
    raw, offs = text_bytes(array)
    words = Words(raw, offs)
    runs, first = shingles(words.hashes(lower=True), words.first, width)
    return runs, first, words.counts


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r) of the Cartesian tree's nodes that span `least` values or more. A node with its parent's value is covered by its parent."""
    out = []
    stack = [(0, len(values) - 1, -1)]
    while stack:
        lo, hi, above = stack.pop()
        while hi - lo + 1 >= least:
            c = lo + int(values[lo : hi + 1].argmin())
            value = int(values[c])
            if value != above:
                out.append((lo, c, hi))
            # The longer side is gone on with, the other waits: the stack stays small.
            if c - lo > hi - c:
                stack.append((c + 1, hi, value))
                hi = c - 1
            else:
                stack.append((lo, c - 1, value))
                lo = c + 1
            above = value
    return out


def _sharers(width: int, min_words: int, bits: int):
    """First pass: which shingles are there at all."""
    least = min_words - width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=STEP):
            runs, first, _ = sequences(batch.column("text"), width)
            counts = np.diff(first)
            known = (counts >= least) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            key, count = np.unique(runs[np.repeat(known, counts)] >> np.uint64(64 - bits), return_counts=True)
            if len(key):
                yield packed_keys(key, count > 1)

    return run


def _sender(buckets: int, hashes: int, width: int, min_words: int, percent: int, table):
    least = min_words - width + 1
    short = -(-least * percent // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in steps(batches, most=STEP):
            runs, first, _ = sequences(batch.column("text"), width)
            shared = in_table(table, runs)
            # The next shared shingle from each place on, and the last one up to it.
            at = np.arange(len(runs))
            after = np.minimum.accumulate(np.where(shared, at, len(runs))[::-1])[::-1]
            before = np.maximum.accumulate(np.where(shared, at, -1))
            # A place is dense where some run of its text around it has PERCENT of shared shingles or more; texts are set so far apart that no run goes over two.
            total = np.concatenate([[0], np.cumsum(np.where(shared, 100 - percent, -percent))])
            apart = np.repeat(np.arange(len(first) - 1), np.diff(first)) * (100 * len(runs) + 1)
            dense = np.maximum.accumulate((total[1:] - apart)[::-1])[::-1] >= np.minimum.accumulate(total[:-1] - apart)
            begin = np.maximum.accumulate(np.where(dense, -1, at)) + 1
            end = np.minimum.accumulate(np.where(dense, len(runs), at)[::-1])[::-1] - 1
            prefix = np.zeros(len(runs) + 1, np.uint64)
            np.cumsum(runs * powers(len(runs) + 1)[0][: len(runs)], out=prefix[1:])
            parts = []
            for which in range(hashes):
                values = mix(runs, 51 + which)
                for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                    a, b = int(first[k]), int(first[k + 1])
                    if doc is None or b - a < least:
                        continue
                    found = a + np.array(compact_windows(values[a:b], least), np.int64).reshape(-1, 3)
                    found = found[shared[found[:, 1]]]
                    c = found[:, 1]
                    lo, hi = after[np.maximum(found[:, 0], begin[c])], before[np.minimum(found[:, 2], end[c])]
                    wide = hi - lo + 1 >= short
                    c, lo, hi = c[wide], lo[wide], hi[wide]
                    part = np.zeros(len(c), _WINDOW)
                    part["key"], part["which"], part["doc"] = mix(values[c], 61 + which), which, doc
                    part["same"] = mix(span_hash(prefix, lo, hi + 1) + (c - lo).astype(np.uint64), 41)
                    part["l"], part["c"], part["r"] = lo - a, c - a, hi - a
                    parts.append(part)
            if not parts:
                continue
            rows = np.concatenate(parts)
            bucket = (rows["key"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows = rows[order]
            full, begins, ends = runs_of(bucket[order])
            blobs = []
            for first_row, last_row in zip(begins.tolist(), ends.tolist(), strict=True):
                own = rows[first_row:last_row]
                blobs.append(packer.compress(b"".join(np.ascontiguousarray(own[name]).tobytes() for name in _WINDOW.names)))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "packed"])

    return run


def _unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // _WINDOW.itemsize
    out, at = np.zeros(n, _WINDOW), 0
    for name in _WINDOW.names:
        kind = _WINDOW[name]
        out[name] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return out


#: key is null in a match of windows a and b; else the row is a window of b that waits for the second round, and la says if it is the first of its class.
MATCH = "key long, a long, b long, which int, la int, ca int, ra int, lb int, cb int, rb int"


def _meet(min_words: int, width: int):
    """Windows of one bucket with equal min-hashes: copies with the first of their class, first windows of classes with the first of all."""
    least = min_words - width + 1

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        reader = zstandard.ZstdDecompressor()
        w = np.concatenate([_unpack(reader.decompress(x.as_buffer())) for batch in batches for x in batch.column("packed")])
        # Most keys stand alone: leave those at once.
        order = np.argsort(w["key"], kind="stable")
        w = w[order]
        twin = np.zeros(len(w), bool)
        same = w["key"][1:] == w["key"][:-1]
        twin[1:] |= same
        twin[:-1] |= same
        w = w[twin]
        if len(w) == 0:
            return
        w = w[np.lexsort((w["l"], w["doc"], w["same"], w["key"]))]
        first = np.ones(len(w), bool)
        first[1:] = (w["key"][1:] != w["key"][:-1]) | (w["same"][1:] != w["same"][:-1])
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        copy = w["doc"] != w["doc"][lead]
        # A copy that is too short for a passage of its own has nothing to find.
        yield from _pairs(w, lead[copy], np.flatnonzero(copy), least, True)
        # The first document's windows; only the very first of a class stands for it as the earlier side.
        w, first = w[~copy], first[~copy]
        order = np.lexsort((w["l"], w["doc"], w["key"]))
        w, first = w[order], first[order]
        _, begins, ends = runs_of(w["key"])
        lead = np.repeat(begins, ends - begins)
        yield from _pairs(w, lead, np.arange(len(w)), least, False)
        other = w["doc"] != w["doc"][lead]
        # Behind the lead, two documents at least: else nothing is left to meet.
        many = np.add.reduceat(other, begins) > 1
        w, first = (x[other & np.repeat(many, ends - begins)] for x in (w, first))
        for k in range(0, len(w), PAIRS):
            part = w[k : k + PAIRS]
            n = len(part)
            none, zero = pa.nulls(n, pa.int64()), np.zeros(n, np.int32)
            columns = [pa.array(part["key"].view(np.int64)), none, pa.array(part["doc"]), pa.array(part["which"].astype(np.int32)), pa.array(first[k : k + PAIRS].astype(np.int32)), pa.array(zero), pa.array(zero)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(part[name])) for name in ("l", "c", "r"))], _MATCH_NAMES)

    return run


_MATCH_NAMES = [c.split(" ")[0] for c in MATCH.split(", ")]


def _pairs(w: np.ndarray, x: np.ndarray, y: np.ndarray, least: int, sure: bool) -> Iterator[pa.RecordBatch]:
    """Windows x with the later documents' windows y; those of one class have a negative `which`."""
    for k in range(0, len(x), PAIRS):
        a, b = w[x[k : k + PAIRS]], w[y[k : k + PAIRS]]
        keep = (a["doc"] < b["doc"]) & (b["r"] - b["l"] + 1 >= least)
        a, b = a[keep], b[keep]
        which = a["which"].astype(np.int32)
        columns = [pa.nulls(len(a), pa.int64()), pa.array(a["doc"]), pa.array(b["doc"]), pa.array(-1 - which if sure else which)] + [pa.array(np.ascontiguousarray(s[name])) for s in (a, b) for name in ("l", "c", "r")]
        yield pa.RecordBatch.from_arrays(columns, _MATCH_NAMES)


def _texts(wanted):
    """The rows of wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            hit = known & in_values(wanted, ids.fill_null(0).to_numpy(zero_copy_only=False))
            if hit.any():
                yield batch.filter(pa.array(hit))

    return run


#: What a place of the second round carries besides its shingles, and that as a schema.
MEETING = {"key": pa.int64(), "which": pa.int32(), "is_late": pa.bool_(), "lates": pa.int32(), "earlies": pa.int32()}
MEETING_SCHEMA = "key long, which int, is_late boolean, lates int, earlies int"


def _fetch(width: int, more: dict[str, pa.DataType]):
    """The passages of each document as texts, with what else their places carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=STEP):
            raw, offs = text_bytes(batch.column("text"))
            words = Words(raw, offs)
            ids, lows, highs, out, rest = [], [], [], [], []
            for k, (doc, places) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("places").to_pylist(), strict=True)):
                begin, n = int(words.first[k]), int(words.counts[k])
                for place in places:
                    lo, last = place["lo"], min(place["hi"] + width, n) - 1
                    if lo <= last:
                        ids.append(doc)
                        lows.append(lo)
                        highs.append(place["hi"])
                        out.append(raw[words.start[begin + lo] : words.end[begin + last]].tobytes())
                        rest.append(place)
            columns = [pa.array(ids, pa.int64()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[c] for r in rest], kind) for c, kind in more.items())], ["doc", "lo", "hi", "passage", *more])

    return run


def _along(x: np.ndarray, y: np.ndarray, hit: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Where x repeats a shingle, take the place that goes on from the neighbour's, forwards and then backwards."""
    if (np.diff(there) == np.diff(hit)).all():
        return there
    places, values, h, n = there.tolist(), y[hit].tolist(), hit.tolist(), len(x)
    xs = x.tolist()
    for order in (range(1, len(h)), range(len(h) - 2, -1, -1)):
        step = -order.step
        for k in order:
            want = places[k + step] + h[k] - h[k + step]
            if want != places[k] and 0 <= want < n and xs[want] == values[k]:
                places[k] = want
    return np.array(places)


def _sighted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of x and where each is first."""
    return np.unique(x, return_index=True)


def similar_spans(x: np.ndarray, y: np.ndarray, least: int, percent: int, x_sighted: tuple[np.ndarray, np.ndarray] | None = None, y_distinct: bool | None = None) -> list[tuple[int, int]]:
    """Spans of y, in shingles, of `least` shingles or more whose similarity with their counterpart in x is `percent` or more.

    x_sighted, y_distinct: `_sighted(x)` and whether y repeats nothing, for callers that compare them often.
    """
    values, first = _sighted(x) if x_sighted is None else x_sighted
    at = np.minimum(np.searchsorted(values, y), max(len(values) - 1, 0))
    hit = np.flatnonzero(values[at] == y) if len(values) else np.zeros(0, np.int64)
    if len(hit) < 2 or hit[-1] - hit[0] + 1 < least:
        return []
    distinct = len(values) == len(x) and (len(np.unique(y)) == len(y) if y_distinct is None else y_distinct)
    there = first[at[hit]] if distinct else _along(x, y, hit, first[at[hit]])
    along, across = np.diff(hit), np.diff(there)
    step = np.maximum(along, np.abs(across))
    # A jump in y or off the diagonal begins a new piece.
    cuts = [0, *(np.flatnonzero((along > GAP) | (np.abs(across - along) > GAP)) + 1).tolist(), len(hit)]
    pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
    out = []
    while pieces:
        i, j = pieces.pop()
        a, b = int(hit[i]), int(hit[j - 1])
        if b - a + 1 < least:
            continue
        c, d = int(there[i:j].min()), int(there[i:j].max())
        if distinct:  # the piece's hits are what both have
            one, two, both = b - a + 1, d - c + 1, j - i
        else:
            own, other = np.unique(y[a : b + 1]), np.unique(x[c : d + 1])
            one, two, both = len(own), len(other), len(np.intersect1d(own, other, assume_unique=True))
        if 100 * both >= percent * (one + two - both):
            out.append((a, b))
            continue
        widest = int(step[i : j - 1].argmax()) + 1 if j - i > 1 else 0
        if widest and step[i + widest - 1] > 1:  # cut at the widest gap
            pieces += [(i, i + widest), (i + widest, j)]
    return out


def _compare(width: int, min_words: int, percent: int):
    least = min_words - width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "passage", STEP):
            rows = []
            x, x_first, _ = sequences(batch.column("earlier"), width)
            y, y_first, _ = sequences(batch.column("passage"), width)
            for k, (a, b, lb) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "lb")), strict=True)):
                spans = similar_spans(x[x_first[k] : x_first[k + 1]], y[y_first[k] : y_first[k + 1]], least, percent)
                rows += [(b, lb + first, lb + last + width, a) for first, last in spans]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "first", "last", "source"])

    return run


SPANS = "doc_id long, first long, last long, source long"


def _passages(docs: DataFrame, places: DataFrame, width: int, more: dict[str, pa.DataType] | None = None, schema: str = ""):
    """(doc, lo, hi, ...) shingles of documents -> the same with their `passage`, each document read once; and the broadcast table to destroy after the job."""
    more = more or {}
    wanted = value_table(places.select("doc").distinct(), places.count())
    texts = docs.mapInArrow(lean(_texts(wanted)), "doc_id long, text string")
    by = places.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi", *more)).alias("places"))
    # A merge join at every size: the places grow with the input, so they are never broadcast.
    joined = by.hint("merge").join(texts, F.col("doc") == F.col("doc_id")).select("doc_id", "places", "text")
    return joined.mapInArrow(lean(_fetch(width, more)), "doc long, lo int, hi int, passage string" + (", " + schema if schema else "")), wanted


def _verified(docs: DataFrame, matches: DataFrame, width: int, min_words: int, percent: int, needed: int) -> DataFrame:
    """The near-duplicate spans among matches (a, b, which, la, ca, ra, lb, cb, rb)."""
    # The interval join: agreeing windows of two documents lie on one diagonal. Two sets of bands, shifted by half, leave no edge.
    diagonal = F.col("cb") - F.col("ca")
    bands = F.array((F.floor(diagonal / BAND) * 2).cast("int"), (F.floor((diagonal + BAND // 2) / BAND) * 2 + 1).cast("int"))
    # Dealt by document pair once, before each match is in two bands.
    banded = matches.repartition("a", "b").withColumn("band", F.explode(bands)).groupBy("a", "b", "band")
    hashes = F.expr("bit_count(bit_or(shiftleft(1, if(which < 0, -1 - which, which))))")
    # The widest window of one class as one long: its width, then where it begins.
    span = F.shiftleft((F.col("rb") - F.col("lb")).cast("long"), 31) + F.col("lb")
    sure = F.max(F.when(F.col("which") < 0, span))
    agreed = banded.agg(hashes.alias("n"), F.min("la").alias("la"), F.max("ra").alias("ra"), F.min("lb").alias("lb"), F.max("rb").alias("rb"), sure.alias("sure")).where((F.col("n") >= needed) | F.col("sure").isNotNull())
    equal = F.col("sure") == span
    once = staged(agreed.groupBy("a", "b", "la", "ra", "lb", "rb").agg(F.coalesce(F.max(equal), F.lit(False)).alias("equal")), "passage-pairs")
    direct = once.where("equal").select(F.col("b").alias("doc_id"), F.col("lb").cast("long").alias("first"), (F.col("rb") + width).cast("long").alias("last"), F.col("a").alias("source"))
    pairs = once.where("not equal").drop("equal")
    sides = F.explode(F.array(F.struct(F.col("a").alias("doc"), F.col("la").alias("lo"), F.col("ra").alias("hi")), F.struct(F.col("b").alias("doc"), F.col("lb").alias("lo"), F.col("rb").alias("hi"))))
    fetched, wanted = _passages(docs, pairs.select(sides.alias("s")).select("s.*"), width)
    fetched = staged(fetched, "passage-texts", compression="zstd")
    wanted.destroy()
    later = pairs.hint("merge").join(fetched, (F.col("b") == F.col("doc")) & (F.col("lb") == F.col("lo")) & (F.col("rb") == F.col("hi"))).select("a", "la", "ra", "b", "lb", "passage")
    earlier = fetched.withColumnRenamed("passage", "earlier")
    both = later.hint("merge").join(earlier, (F.col("a") == F.col("doc")) & (F.col("la") == F.col("lo")) & (F.col("ra") == F.col("hi"))).select("a", "b", "lb", "earlier", "passage")
    return direct.unionByName(both.mapInArrow(lean(_compare(width, min_words, percent)), SPANS))


def best_runs(shared: np.ndarray, own: np.ndarray, gain: int, least: int) -> np.ndarray:
    """The largest sum of `least` columns or more, from a shared to a shared one, in each row: `gain` for a shared column, else -own. Without such a run it is far below 0."""
    n = shared.shape[1] + 1 - least
    kind, far = (np.int32, FAR >> 31) if shared.shape[1] * max(gain, int(own.max())) < FAR >> 31 else (np.int64, FAR)
    total = np.zeros((shared.shape[0], shared.shape[1] + 1), kind)
    np.cumsum(np.where(shared, kind(gain), -own.astype(kind)), axis=1, out=total[:, 1:])
    low = np.minimum.accumulate(np.where(shared[:, :n], total[:, :n], kind(far)), axis=1)
    return np.where(shared[:, least - 1 :], total[:, least:] - low, kind(-far)).max(1)


def best_pieces(gain: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The largest sum of neighbours in each piece of a flat array; no piece is empty."""
    total = np.concatenate([[0], np.cumsum(gain)])
    apart = np.repeat(np.arange(len(offs) - 1), np.diff(offs)) * (2 * np.abs(gain).sum() + 1)
    low = np.minimum.accumulate(total[:-1] - apart)
    return np.maximum.reduceat(total[1:] - apart - low, offs[:-1])


def unshared(rank: np.ndarray, held: int, least: int, percent: int) -> int:
    """How many of the `held` values of lowest rank make no run of `least` places or more similar to what holds no others of its values."""
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    last = np.full(n, -1)
    again = rank[order[1:]] == rank[order[:-1]]
    last[order[1:][again]] = order[:-1][again]
    # A place counts for the runs of `least` places that begin after its value's last sighting and hold it.
    begin, end = np.maximum(np.maximum(last, np.arange(n) - least) + 1, 0), np.arange(1, n + 1)
    low, high = 0, held
    while low < high:
        few = (low + high + 1) // 2
        other = rank >= few
        change = np.bincount(begin[other], minlength=n + 1) - np.bincount(end[other], minlength=n + 1)
        # Of a similar run's values, PERCENT are shared: the others are so many at most.
        if np.cumsum(change)[: n - least + 1].min() > few * (100 - percent) // percent:
            low = few
        else:
            high = few - 1
    return low


def late_spans(x: list[np.ndarray], x_doc: np.ndarray, y: list[np.ndarray], y_doc: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(place in y, first, last shingle, place in x): the spans of each y that the first x of a smaller document which has such gives."""
    out = []
    # Spans are similar where (100 + percent) * both >= percent * (one + two): half of it for either side, (100 - percent) * both - 2 * percent * own.
    # A value counts as its side's own where it is new, so repeats leave these upper bounds.
    vocabulary, flat = np.unique(np.concatenate(x), return_inverse=True)
    lengths = np.array([len(t) for t in x])
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    many = len(x) > FEW
    if many:  # which x hold a value, ascending; each x once
        holds = np.unique(flat * len(x) + np.repeat(np.arange(len(x)), lengths))
        first = np.searchsorted(holds // len(x), np.arange(len(vocabulary) + 1))
        holders, often = holds % len(x), np.diff(first)
    place = np.full(len(vocabulary), -1)
    # Only of those that the first bound lets through.
    own_x: dict[int, np.ndarray] = {}
    sighted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(len(y)):
        if len(y[k]) < least:
            continue
        values, at, inverse = np.unique(y[k], return_index=True, return_inverse=True)
        plain = len(values) == len(y[k])
        own_y = np.zeros(len(y[k]), np.int64)
        own_y[at] = percent
        slot = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
        hit = np.flatnonzero(vocabulary[slot] == values)
        known = slot[hit]
        early = np.flatnonzero(x_doc < y_doc[k])
        if many and len(known) and len(early):
            order = np.argsort(-often[known], kind="stable")
            rank = np.arange(len(values)) + len(known)
            rank[hit[order]] = np.arange(len(known))
            # A similar x has one of y's values besides the most held ones: rarest first, copies of a frequent sentence cost nothing.
            most, usual = unshared(rank[inverse], len(known), least, percent), int((often[known] * 8 > len(x)).sum())
            if usual > most and best_runs((rank[inverse] < usual)[None], own_y, 100 - percent, least)[0] < 0:
                most = usual
            rare = known[order][most:]
            if len(rare) == 0:
                continue
            some = np.cumsum(often[rare])
            early = np.unique(holders[np.repeat(first[rare] - some + often[rare], often[rare]) + np.arange(some[-1])])
            early = early[x_doc[early] < y_doc[k]]
        if len(known) == 0 or len(early) == 0:
            continue
        place[known] = hit
        # Steps of bounded size, by what the early ones and their rows of the matrix hold.
        step = np.cumsum(lengths[early] + len(y[k])) // (CELLS >> 2)
        for part in np.split(early, np.flatnonzero(np.diff(step)) + 1):
            ids = np.concatenate([flat[cuts[m] : cuts[m + 1]] for m in part.tolist()])
            mine = place[ids]
            row = np.repeat(np.arange(len(part)), lengths[part])
            matrix = np.zeros((len(part), len(values)), bool)
            matrix[row[mine >= 0], mine[mine >= 0]] = True
            shared = matrix[:, inverse]
            some = best_runs(shared, own_y, 100 - percent, least) >= 0
            if not some.any():
                continue
            mine, part, shared = mine[np.repeat(some, lengths[part])], part[some], shared[some]
            for m in part.tolist():
                if m not in own_x:
                    sighted[m] = _sighted(x[m])
                    own_x[m] = np.zeros(len(x[m]), np.int64)
                    own_x[m][sighted[m][1]] = 2 * percent
            offs = np.concatenate([[0], np.cumsum(lengths[part])])
            theirs = best_pieces(np.where(mine >= 0, 100 - percent, -np.concatenate([own_x[m] for m in part.tolist()])), offs)
            some = best_runs(shared, 2 * own_y, 100 - percent, least) + theirs >= 0
            spans = []
            for m in part[some].tolist():
                spans = similar_spans(x[m], y[k], least, percent, sighted[m], plain)
                out += [(k, a, b, m) for a, b in spans]
                if spans:
                    break
            if spans:
                break
        place[known] = -1
    return out


def _late(width: int, min_words: int, percent: int):
    least = min_words - width + 1

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("which", "ascending"), ("is_late", "ascending"), ("doc", "ascending"), ("lo", "ascending")])
        columns = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("key", "which", "is_late", "doc", "lo")}
        tokens = []
        for batch in steps(iter(table.select(["passage"]).to_batches()), "passage", STEP):
            runs, first, _ = sequences(batch.column("passage"), width)
            tokens += np.split(runs, first[1:-1])
        rows = []
        begins = np.flatnonzero(np.concatenate([[True], (columns["key"][1:] != columns["key"][:-1]) | (columns["which"][1:] != columns["which"][:-1])]))
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(tokens)], strict=True):
            cut = a + int((~columns["is_late"][a:b]).sum())
            if a < cut < b:
                doc, lo = columns["doc"], columns["lo"]
                rows += [(int(doc[cut + k]), int(lo[cut + k] + first), int(lo[cut + k] + last + width), int(doc[a + m])) for k, first, last, m in late_spans(tokens[a:cut], doc[a:cut], tokens[cut:b], doc[cut:b], least, percent)]
        give_back()
        return pa.table({c.split(" ")[0]: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(SPANS.split(", "))})

    return run


def _second_round(docs: DataFrame, waiting: DataFrame, spans: DataFrame, width: int, min_words: int, percent: int) -> DataFrame:
    """Spans of waiting windows with room for a passage that `spans` don't have."""
    least = min_words - width + 1
    room = _left_over(F.col("spans"), F.col("lb"), F.col("rb") + width) >= min_words
    known = disjoint(spans).withColumnRenamed("doc_id", "known")
    wide = waiting.where(F.col("rb") - F.col("lb") + 1 >= least).hint("merge").join(known, F.col("b") == F.col("known"), "left").where(room)
    names = [F.col("b").alias("doc"), F.col("lb").alias("lo"), F.col("rb").alias("hi")]
    late = staged(wide.select("key", "which", *names), "passage-late")
    keys = late.groupBy("key", "which").agg(F.count("*").alias("n_late"))
    early = waiting.where("la = 1").select("key", "which", *names).hint("merge").join(keys.drop("n_late"), ["key", "which"], "left_semi")
    rows = staged(late.withColumn("is_late", F.lit(True)).unionByName(early.withColumn("is_late", F.lit(False))), "passage-meeting")
    # Tiles of late by tiles of early windows; a usual min-hash has one of each, and shares its bucket with others.
    sizes = rows.groupBy("key", "which").agg(F.ceil(F.count_if("is_late") / TILE).cast("int").alias("lates"), F.ceil(F.count_if(~F.col("is_late")) / TILE).cast("int").alias("earlies"))
    buckets = int(max(16, rows.count() // ROUND_BUCKET))
    sized = rows.hint("merge").join(sizes, ["key", "which"]).where("lates > 0 and earlies > 0")
    # The passages go from their documents to their tiles at once.
    full, wanted = _passages(docs, staged(sized, "passage-sized"), width, MEETING, MEETING_SCHEMA)
    own = F.pmod(F.xxhash64("doc", "lo", "hi"), F.when(F.col("is_late"), F.col("lates")).otherwise(F.col("earlies"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("is_late"), F.col("earlies")).otherwise(F.col("lates")) - 1)
    dealt = full.withColumn("own", own).withColumn("other", F.explode(others)).select(F.pmod(F.xxhash64("key", "which"), F.lit(buckets)).alias("bucket"), F.when(F.col("is_late"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("is_late"), F.col("other")).otherwise(F.col("own")).alias("j"), "key", "which", "is_late", "doc", "lo", "passage")
    out = staged(dealt.groupBy("bucket", "i", "j").applyInArrow(_late(width, min_words, percent), SPANS), "passage-later")
    wanted.destroy()
    return out


def _left_over(spans, begin, end):
    """The longest run of words from begin to end that disjoint, ascending spans leave out."""
    begin, end = begin.cast("long"), end.cast("long")
    start = F.struct(begin.alias("at"), F.lit(0).cast("long").alias("best"))

    def step(s, x):
        gap = F.least(x["first"], end) - s["at"]
        return F.struct(F.greatest(s["at"], x["last"]).alias("at"), F.greatest(s["best"], gap).alias("best"))

    return F.aggregate(F.coalesce(spans, F.expr("array_repeat(named_struct('first', 0L, 'last', 0L), 0)")), start, step, lambda s: F.greatest(s["best"], end - s["at"]))


def passage_spans(docs: DataFrame, width: int = WIDTH, min_words: int = MIN_WORDS, percent: int = PERCENT, hashes: int = HASHES, needed: int = NEEDED) -> DataFrame:
    """(doc_id, first, last, source): words first to last (exclusive) of the document near-duplicate a passage of the earlier document `source`."""
    docs = documents(docs)
    size = docs.agg(F.sum(F.length("text"))).collect()[0][0] or 0  # of characters: four times the words at least
    buckets = int(max(16, size // 200 * hashes * _WINDOW.itemsize // 3 // BUCKET_BYTES))
    bits = key_bits(size)
    table = shared_table(docs.mapInArrow(lean(_sharers(width, min_words, bits)), "bucket int, packed binary"), bits, table_bits(size // 4))
    packed = docs.mapInArrow(lean(_sender(buckets, hashes, width, min_words, percent, table)), "bucket int, packed binary")
    met, met_path = staged_at(packed.groupBy("bucket").applyInArrow(lean_groups(_meet(min_words, width)), MATCH), "passage-matches", compression="zstd")
    table.destroy()
    spans, first_path = staged_at(_verified(docs, met.where("key is null"), width, min_words, percent, needed).distinct(), "passage-spans")
    more = _second_round(docs, met.where("key is not null"), spans, width, min_words, percent)
    out = staged(spans.unionByName(more).distinct(), "passage-all")
    unstage(docs.sparkSession, met_path, first_path)
    return out


def disjoint(spans: DataFrame) -> DataFrame:
    """(doc_id, first, last) -> (doc_id, spans): a document's spans as disjoint, ascending (first, last) pairs."""
    # A document's spans: as many as its own windows let it have.
    by = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("raw"))
    none = F.expr("array_repeat(named_struct('first', 0L, 'last', 0L), 0)")

    def join(done, x):
        top = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= x["first"]), grown).otherwise(F.concat(done, F.array(x)))

    return by.select("doc_id", F.aggregate("raw", none, join).alias("spans"))


def passage_table(docs: DataFrame, **options: int) -> DataFrame:
    """(doc_id, spans, sources) of the documents that hold near duplicates: spans are disjoint, ascending (first, last) pairs of words."""
    found = passage_spans(docs, **options)
    return disjoint(found).join(found.groupBy("doc_id").agg(F.sort_array(F.collect_set("source")).alias("sources")), "doc_id")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, most=STEP):
        counts = Words(*text_bytes(batch.column("text"))).counts
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts.astype(np.int64))], ["doc_id", "n_words"])


def passage_report(docs: DataFrame, **options: int) -> DataFrame:
    """A row for each row of docs: its words, near-duplicate words and spans, and the earlier documents that they come from."""
    table = staged(passage_table(docs, **options), "passage-table")
    counts = documents(docs).mapInArrow(lean(_word_counts), "doc_id long, n_words long")
    out = counts.join(table, "doc_id", "left")
    none = F.expr("array_repeat(named_struct('first', 0L, 'last', 0L), 0)")
    own = F.filter(F.transform(F.coalesce("spans", none), lambda s: F.struct(s["first"].alias("first"), F.least(s["last"], F.col("n_words")).alias("last"))), lambda s: s["first"] < s["last"])
    out = out.withColumn("spans", own)
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return out.select("doc_id", "n_words", words.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", F.coalesce("sources", F.array().cast("array<long>")).alias("sources"))


def _cut(text: str | None, spans: list[dict]) -> str:
    """A text without the words of its spans."""
    raw, offs = text_bytes(pa.array([text or ""], pa.large_string()))
    words = Words(raw, offs)
    data, out, at, n = raw.tobytes(), [], 0, int(words.counts[0])
    for s in spans:
        if s["first"] < n:
            out.append(data[at : words.start[s["first"]]])
            at = int(words.end[min(s["last"], n) - 1])
    return b"".join([*out, data[at:]]).decode()


def remove_passages(docs: DataFrame, **options: int) -> DataFrame:
    """docs without the near-duplicate passages of earlier documents; all columns stay, n_chars follows the text where there is one.

    A document that loses all its words goes.
    """
    table = staged(disjoint(passage_spans(docs, **options)), "passage-table")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    joined = whole.join(table.hint("merge"), F.col("whole.doc_id").cast("long") == F.col("doc_id"), "left").select("whole", "spans")
    clean = joined.where("spans is null").select("whole.*")
    hit = joined.where("spans is not null").select(F.col("whole.text").alias("text"), "spans", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_cut(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("whole")], ["text", "whole"])

    kind = joined.schema["whole"].dataType
    cut = hit.mapInArrow(run, f"text string, whole {kind.simpleString()}").where(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")) > 0)
    changed = {"text": F.col("text"), "n_chars": F.length("text")}
    return clean.unionByName(cut.select(*[changed.get(c, F.col("whole").getField(c)).cast(kind[c].dataType).alias(c) for c in docs.columns]))
