"""BPE encoding and decoding by tree concatenation.

A long unsplit piece of text is halved down to leaves, the leaves are encoded in one parallel library call, and
neighbours are joined bottom-up: a window around the join is encoded anew and grown until it shares two whole tokens with the
left part and two with the right part. A BPE sequence is the encoding of its text exactly if each pair of
neighbouring tokens is, so left tokens up to the shared ones, the window's, and right tokens from the shared ones on are the exact
encoding. A window that has grown over both parts is itself that encoding, so the result is exact in any case.

Null or empty text: no ids, an empty decoded text. Repeated rows give a row each. Texts of any length are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, steps
from .tokens import LONG, Encoder, vocabulary

#: Characters of a leaf; characters to each side of a join in its first window.
LEAF, WINDOW = 1024, 64

Part = tuple[list[int], list[tuple[int, int]]]


class TreeEncoder:
    """Encodes long texts by halves with one tokenizer of the library."""

    def __init__(self, tokenizer, leaf: int = LEAF, window: int = WINDOW) -> None:
        self.tokenizer, self.leaf, self.window = tokenizer, max(leaf, 1), window

    def __call__(self, texts: list[str]) -> list[list[int]]:
        cuts = [self._cuts(0, len(t)) for t in texts]
        encoded = iter(self.tokenizer.encode_batch([t[a:b] for t, c in zip(texts, cuts, strict=True) for a, b in c], add_special_tokens=False))
        out = []
        for text, spans in zip(texts, cuts, strict=True):
            parts = [(span, self._part(next(encoded), span[0])) for span in spans]
            while len(parts) > 1:  # a level of the tree
                parts = [((a[0][0], b[0][1]), self._join(text, a, b)) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) & ~1 :]
            out.append(parts[0][1][0])
        return out

    def _cuts(self, a: int, b: int) -> list[tuple[int, int]]:
        if b - a <= self.leaf:
            return [(a, b)]
        return self._cuts(a, (a + b) // 2) + self._cuts((a + b) // 2, b)

    @staticmethod
    def _part(encoding, at: int) -> Part:
        return encoding.ids, [(a + at, b + at) for a, b in encoding.offsets]

    def _join(self, text: str, left: tuple[tuple[int, int], Part], right: tuple[tuple[int, int], Part]) -> Part:
        (lo, cut), (lids, lspans) = left
        (_, hi), (rids, rspans) = right
        width = self.window
        while True:
            a, b = max(lo, cut - width), min(hi, cut + width)
            wids, wspans = self._part(self.tokenizer.encode(text[a:b], add_special_tokens=False), a)
            if (a, b) == (lo, hi):
                return wids, wspans
            x = (0, 0) if a == lo else self._shared(lids, lspans, wids, wspans, cut, True)
            y = (len(wids), len(rids)) if b == hi else self._shared(rids, rspans, wids, wspans, cut, False)
            if x and y and x[1] <= y[0]:
                return lids[: x[0]] + wids[x[1] : y[0]] + rids[y[1] :], lspans[: x[0]] + wspans[x[1] : y[0]] + rspans[y[1] :]
            width *= 2

    @staticmethod
    def _shared(ids: list[int], spans: list, wids: list[int], wspans: list, cut: int, left: bool) -> tuple[int, int] | None:
        """Where a part and the window may be exchanged: behind two tokens that both have, on the part's side of the cut."""
        if not wspans:
            return None
        at = {span: k for k, span in enumerate(wspans)}
        order = range(len(ids) - 2, 0, -1) if left else range(1, len(ids))
        for k in order:
            if (spans[k][0] < wspans[0][0]) if left else (spans[k][1] > wspans[-1][1]):
                return None
            j = at.get(spans[k], 0)
            if 0 < j < len(wids) - 1 and spans[k][0] < spans[k][1] and ids[k - 1 : k + 1] == wids[j - 1 : j + 1] and spans[k - 1] == wspans[j - 1] and (spans[k][1] < cut if left else spans[k - 1][0] > cut):
                return (k, j) if left else (j, k)
        return None


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, tokenizer: str, most: int = 400_000) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the ids as decimals joined by a space, and their decoding, of each whole text."""
    return documents(docs).mapInArrow(_encoder(tokenizer, most, False), "doc_id long, n_tokens long, ids string, decoded string")


def encode_digests(docs: DataFrame, tokenizer: str, most: int = 400_000) -> DataFrame:
    """encode_texts with the SHA-256 digests of its two strings in their place."""
    return documents(docs).mapInArrow(_encoder(tokenizer, most, True), SCHEMA)


def _encoder(tokenizer: str, most: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(tokenizer), most=most, long=LONG)
        encoder.long_text = TreeEncoder(encoder.tokenizer)
        sha = (lambda s: hashlib.sha256(s.encode()).hexdigest()) if digest else (lambda s: s)
        for batch in steps(batches):
            rows = encoder.digests(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([sha(r[1]) for r in rows], pa.string()), pa.array([sha(r[2]) for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"])

    return run
