"""The costly functions of texts in Python: scored sentences, summaries and hashed word counts, a batch of texts at a time.

They give what the Column expressions of the same definitions give, which Spark interprets for each element of each array: white space is ASCII's, words are
runs of letters, numbers and `_`, and rounding is half up in decimal digits.
"""

from __future__ import annotations

import re
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOP_WORDS

_SPACE = "[ \\t\\n\\x0b\\f\\r]+"
_GAP, _BETWEEN, _WORD = re.compile(f"(?<=[.!?]){_SPACE}"), re.compile(_SPACE), re.compile("\\w+")
#: As Java's `$`: also before a last line terminator.
_ENDS = re.compile(f"^{_SPACE}|{_SPACE}(?=[\\x85\\u2028\\u2029]?\\Z)")
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c == 95 else 32 for c in range(128)) + bytes(range(128, 256))
#: Words that a worker remembers.
MEMORY = 1 << 20


class _Telling(dict):
    """Whether a word has three ASCII letters or more, nothing else, and is no stop word."""

    def __missing__(self, word: str) -> bool:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = out = _plain(word) and word not in _STOP
        return out


class _Hashed(dict):
    """The leading 32 bits of a content word's MD5; -1 for other words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = out = int(md5(word.encode()).hexdigest()[:8], 16) if _plain(word) else -1
        return out


_STOP, _telling, _hashed = frozenset(STOP_WORDS), _Telling(), _Hashed()


def _plain(word: str) -> bool:
    return len(word) >= 3 and word.isascii() and word.isalpha()


def _words(text: str) -> list[str]:
    """Lower-cased runs of letters, numbers and `_`."""
    return text.encode().translate(_ASCII).decode().split() if text.isascii() else _WORD.findall(text.lower())


def strip(text: str) -> str:
    return _ENDS.sub("", text) if text[-1:] in "\x85\u2028\u2029" else text.strip(" \t\n\x0b\f\r")


def pieces(text: str) -> int:
    """Pieces between white space; a blank text has one."""
    return max(1, len(strip(text).encode().split()))


def tokens_of(text: str) -> int:
    return int(pieces(text) / 0.75 + 0.5) if strip(text) else 0


def cut(text: str, tokens: int) -> str:
    if tokens_of(text) <= tokens:
        return text
    return " ".join(_BETWEEN.split(strip(text))[: max(1, round(tokens * 0.75))]) + " ..."


def sentences(text: str) -> list[str]:
    return [s for x in _GAP.split(text) if (s := strip(x))]


@lru_cache(1 << 16)
def _score(hits: int, own: int, length: int) -> float:
    if own == 0:
        return 0.0
    return float(Decimal(repr(hits / own + min(length / 20.0, 1.0) * 0.2)).quantize(Decimal("1e-9"), ROUND_HALF_UP))


def scored(found: list[str], most: int) -> list[tuple[float, int, int, int]]:
    """(0 - score, place, hits, tokens) of each sentence, in text order; `most`: the number of top words. Sentences end at white space, so their words are the text's."""
    told = [[w for w in _words(s) if _telling[w]] for s in found]
    top = {w for w, _ in Counter([w for ws in told for w in ws]).most_common(most)}
    out = []
    for k, (s, ws) in enumerate(zip(found, told, strict=True)):
        own, n = set(ws), pieces(s)
        hits = len(own & top)
        out.append((0.0 - _score(hits, len(own), min(n, 20)), k, hits, tokens_of(s)))
    return out


def fitting(ranked: list[tuple[float, int, int, int]], tokens: int) -> int:
    used = 0
    for n, x in enumerate(ranked):
        used += x[3]
        if used > tokens:
            return n
    return len(ranked)


def summary(text: str, tokens: int) -> str:
    found = sentences(text)
    if len(found) < 2:
        return cut(found[0] if found else text, tokens)
    ranked = sorted(scored(found, 20))
    n = fitting(ranked, tokens)
    if n == 0:
        return cut(found[ranked[0][1]], tokens)
    last = {s: k for k, s in enumerate(found)}
    return " ".join(found[k] for _, _, k in sorted((last[found[x[1]]], rank, x[1]) for rank, x in enumerate(ranked[:n])))


def _lists(offsets: list[int], **columns: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def sentence_table(text: Column, most: int, tokens: int) -> Column:
    """array<struct<pos, score, picked, hits>> of a text of two sentences or more in text order, else an empty array.

    most: the number of top words; tokens: the budget of the summary whose sentences are `picked`.
    """

    def run(texts: pa.Array) -> pa.Array:
        ends, pos, score, picked, hits = [0], [], [], [], []
        for t in texts.to_pylist():
            found = sentences(t) if t is not None else []
            if len(found) >= 2:
                rows = scored(found, most)
                ranked = sorted(rows)
                chosen = {x[1] for x in ranked[: fitting(ranked, tokens)]}
                pos += range(len(rows))
                score += [0.0 - x[0] for x in rows]
                picked += [x[1] in chosen for x in rows]
                hits += [x[2] for x in rows]
            ends.append(len(pos))
        return _lists(ends, pos=pa.array(pos, pa.int64()), score=pa.array(score, pa.float64()), picked=pa.array(picked, pa.bool_()), hits=pa.array(hits, pa.int64()))

    return F.arrow_udf(run, "array<struct<pos:long,score:double,picked:boolean,hits:long>>")(text)


def extractive(text: Column, tokens: int, whole: bool = False) -> Column:
    """text.extractive. `whole`: a text of no more than `tokens` tokens stays as it is."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t if whole and tokens_of(t) <= tokens else summary(t, tokens) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def each_extractive(texts: Column, toks: Column, tokens: int) -> Column:
    """text.extractive of those texts of an array that have more than `tokens` tokens, the others as they are."""

    def run(lists: pa.Array, counts: pa.Array) -> pa.Array:
        return pa.array([None if ts is None else [t if t is None or n <= tokens else summary(t, tokens) for t, n in zip(ts, ns, strict=True)] for ts, ns in zip(lists.to_pylist(), counts.to_pylist(), strict=True)], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(texts, toks)


def hashed_embedding(text: Column, dim: int) -> Column:
    """vectors.hashed_embedding"""

    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), dim))
        none = np.zeros(len(texts), bool)
        for k, t in enumerate(texts.to_pylist()):
            none[k] = t is None
            places = [h % dim for w in _words(t) if (h := _hashed[w]) >= 0] if t is not None else []
            if places:
                out[k] = np.bincount(places, minlength=dim)
                out[k] /= np.sqrt((out[k] ** 2).sum())  # whole numbers: the same sum in any order
        ends = np.append(0, np.cumsum(~none)) * dim  # a null list has no values of its own
        offsets = pa.array(ends, pa.int32(), mask=np.append(none, False) if none.any() else None)
        return pa.ListArray.from_arrays(offsets, pa.array(out[~none].ravel()))

    return F.arrow_udf(run, "array<double>")(text)
