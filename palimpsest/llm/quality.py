"""Quality rules: hashed n-gram logistic regression beside fixed base rules.

The classifier is trained on a bounded, documented sample of labelled rows (`max_labelled`, those with
the smallest hash of doc_id); everything else covers every row and every whole text. A text's features
are the relative frequencies of its hashed word unigrams and of its hashed byte 1- to 3-grams, so a score is the
mean weight of its n-grams: linear, one pass, no per-text tables. Probabilities are calibrated on a held-out
quarter of the sample (Platt).

Null or empty text: no words, base_failed, not kept. No labelled rows of both classes: the verdict is the
base rules' alone. Repeated rows and repeated doc_ids give a row each; conflicting labels of one doc_id count
as the lowest. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Words, documents, lean, mix, prefix_hash, segment_sums, shingles, span_hash, steps, text_bytes

#: Production parameters.
MAX_LABELLED, BITS, THRESHOLD, MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 2000, 15, 0.5, 20, 30, 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass
class Model:
    words: np.ndarray
    chars: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -50, 50)))


def _grams(raw: np.ndarray, offs: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash slots, offsets of the texts) for byte 1- to 3-grams; those that cross texts are left out by offsets."""
    code = np.zeros(len(raw), np.uint32)
    for n in range(1, 4):
        m = len(raw) - n + 1
        if m <= 0:
            return
        code = code[:m] * np.uint32(256) + raw[n - 1 :]
        slot = ((code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - bits)).astype(np.int32)
        yield slot, n


def _logits(raw: np.ndarray, offs: np.ndarray, words: Words, model: Model, hashes: np.ndarray) -> np.ndarray:
    bits = int(np.log2(len(model.words)))
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    out = model.bias + segment_sums(model.words[slot], words.first) / np.maximum(words.counts, 1)
    size = np.diff(offs)
    for slot, n in _grams(raw, offs, bits):
        total = np.concatenate([[0.0], np.cumsum(model.chars[slot])])
        last = np.maximum(offs[1:] - n + 1, offs[:-1])
        out = out + (total[np.minimum(last, len(slot))] - total[np.minimum(offs[:-1], len(slot))]) / np.maximum(size, 1)
    return out


def train(texts: list[str], good: np.ndarray, bits: int = BITS, rounds: int = 100) -> Model | None:
    """Weighted logistic regression on hashed n-grams; three quarters fit the weights, one quarter the calibration."""
    if len(texts) == 0 or good.min() == good.max():
        return None
    width = 1 << bits
    n = len(texts)
    rows, cols, values = [], [], []

    def put(slot: np.ndarray, text: np.ndarray, total: np.ndarray, base: int, first: int) -> None:
        key, count = np.unique(text.astype(np.int64) * width + slot, return_counts=True)
        rows.append((key // width + first).astype(np.int32))
        cols.append((key % width + base).astype(np.int32))
        values.append(count / np.maximum(total, 1)[key // width])

    first = 0
    for batch in steps(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])]), most=1 << 19):
        raw, offs = text_bytes(batch.column("text"))
        words = Words(raw, offs)
        put((words.hashes() >> np.uint64(64 - bits)).astype(np.int64), words.text_of(), words.counts, 0, first)
        size = np.diff(offs)
        owner = np.repeat(np.arange(len(size)), size)
        for slot, k in _grams(raw, offs, bits):
            inside = owner[: len(slot)] == owner[k - 1 :]
            put(slot[inside].astype(np.int64), owner[: len(slot)][inside], size, width, first)
        first += len(size)
    row, col, value = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
    scale = 20.0
    value = value * scale
    hold = np.arange(n) % 4 == 3
    if good[hold].min() == good[hold].max() or good[~hold].min() == good[~hold].max():
        hold = np.zeros(n, bool)
    fit = ~hold
    weight = np.where(good == 1, 0.5 / max(good[fit].sum(), 1), 0.5 / max((1 - good[fit]).sum(), 1)) * fit
    w, bias = np.zeros(2 * width), 0.0
    m, v, mb, vb = np.zeros(2 * width), np.zeros(2 * width), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[col], n) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - good) * weight
        grad, gb = np.bincount(col, value * g[row], 2 * width) + 1e-5 * w, g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.1 / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    z = np.bincount(row, value * w[col], n) + bias
    slope, shift = 1.0, 0.0
    if hold.any():
        x, y = z[hold], good[hold].astype(float)
        y = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        loss = lambda a, b: -(y * (u := np.clip(a * x + b, -50, 50)) - np.log1p(np.exp(u))).sum() + 1e-3 * (a * a + b * b)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -50, 50)))
            r, s = p - y, p * (1 - p) + 1e-9
            h = np.array([[(s * x * x).sum() + 2e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 2e-3]])
            step, now, rate = np.linalg.solve(h, [(r * x).sum() + 2e-3 * slope, r.sum() + 2e-3 * shift]), loss(slope, shift), 1.0
            while rate > 1e-4 and loss(slope - rate * step[0], shift - rate * step[1]) > now:
                rate /= 2
            slope, shift = slope - rate * step[0], shift - rate * step[1]
    return Model(w[:width] * scale, w[width:] * scale, bias, float(slope), float(shift))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[list[str], np.ndarray]:
    """The bounded sample that the classifier is fitted on: at most `most` rows, by the hash of doc_id."""
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most `most` rows of two numbers: a bounded broadcast.
    firsts = documents(docs).join(F.broadcast(chosen), "doc_id")
    rows = firsts.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).collect()
    return [r.text for r in rows], np.array([int(r.quality) for r in rows], np.int64)


def base_measures(raw: np.ndarray, offs: np.ndarray, words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offs) - 1
    lead = (raw & 0xC0) != 0x80
    out = {"n_words": words.counts, "word_chars": segment_sums((lead & ~SPACE[raw]).astype(np.int64), offs), "n_symbols": segment_sums(_SYMBOL[raw].astype(np.int64), offs)}
    # Lines: they start at each text and after each \n.
    cut = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([offs[:-1], cut + 1]), kind="stable")
    owner = np.searchsorted(offs, start, "right") - 1
    # A line after a text's last \n is empty and starts where the next text does: it holds no word.
    end = np.minimum(np.concatenate([start[1:], offs[-1:]]), offs[np.minimum(owner + 1, n)])
    end = np.where((end > start) & (raw[np.maximum(end - 1, 0)] == 10) if len(raw) else False, end - 1, end)
    wordy = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, owner = start[wordy], end[wordy], owner[wordy]
    key = mix(span_hash(prefix_hash(raw), start, end) + owner.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019), 3)
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    out["n_dup_lines"] = np.bincount(owner[order][same], minlength=n)
    # Words in windows found twice or more.
    grams, first = shingles(hashes, words.first, WINDOW)
    owner = np.repeat(np.arange(n), np.diff(first))
    key = mix(grams + owner.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019), 5)
    order = np.argsort(key)
    twin = np.zeros(len(key), bool)
    if len(key) > 1:
        again = key[order][1:] == key[order][:-1]
        twin[order[1:][again]] = True
        twin[order[:-1][again]] = True
    at = np.flatnonzero(twin)
    at = at + (words.first[:-1] - first[:-1])[owner[at]]
    edge = np.bincount(at, minlength=len(hashes) + WINDOW + 1) - np.bincount(at + WINDOW, minlength=len(hashes) + WINDOW + 1)
    covered = (np.cumsum(edge)[: len(hashes)] > 0).astype(np.int64)
    out["n_repeat_words"] = segment_sums(covered, words.first)
    return out


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def _measured(batch: pa.RecordBatch, model: Model | None, threshold: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(base measures, base_failed, probability) of a step's texts."""
    raw, offs = text_bytes(batch.column("text"))
    words = Words(raw, offs)
    hashes = words.hashes()
    out = base_measures(raw, offs, words, hashes)
    failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    return out, failed, model.probability(_logits(raw, offs, words, model, hashes)) if model else np.ones(len(failed))


def quality_verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """A row for each row of docs: its base measures, base_failed, the calibrated probability of good quality, kept."""
    model = train(*labelled(docs, labels, max_labelled))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out, failed, chance = _measured(batch, model, threshold)
            columns = [batch.column("doc_id"), *(pa.array(out[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(~failed & (chance >= threshold)), pa.array(chance)]
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in SCHEMA.split(", ")])

    return documents(docs).mapInArrow(lean(score), SCHEMA)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that quality_verdicts keeps, all columns as they are."""
    model = train(*labelled(docs, labels, max_labelled))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            _, failed, chance = _measured(batch, model, threshold)
            yield batch.filter(pa.array(~failed & (chance >= threshold)))

    return docs.mapInArrow(lean(passed), docs.schema)
