"""Exact library tokenisation with a memory of pieces.

A text is cut where the tokenizer's own pre-tokenisation always cuts. Texts in Latin-1 are cut into the
pre-tokens themselves (the published split patterns, with their classes spelled out for Latin-1, where the
vocabularies' normalisers change no boundary). Other texts, and those that hold a special token's string, are
cut only at spaces that follow a non-space (byte-level) or at spaces and newlines (vocabularies that drop white space).
The tokenizers library encodes each distinct piece once per worker and memory generation (a worker's tasks share one memory); a
text's ids are those of its pieces. The memory is cleared beyond `MOST` pieces, and long pieces are encoded by `long_text`
and forgotten with it, so a worker's memory is bounded.

`Encoder.encode` cuts a step's byte-level Latin-1 texts at once, one byte a character, by the same rules as the split pattern, and looks
pieces of at most SHORT characters up by those bytes themselves (two words of 64 bits, no hash in their place).
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces in memory; characters from which a piece is long.
MOST, LONG = 600_000, 1024
#: New words that one library call encodes together.
SENTENCE = 512
_CUT = re.compile(r"(?<=\S)(?= )")
_BREAK = re.compile(r"[ \n]+")
# Letters, numbers and white space of Latin-1, and the two vocabularies' published split patterns in them.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_BYTE_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORD_END = re.compile(f"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_WIDE = re.compile("[^\x00-\xff]")
#: Kinds of Latin-1 characters: letters, numbers, white space; 0 is the rest.
_LETTER, _WHITE = 1, 3
_KIND = np.zeros(256, np.uint8)
for _k, _class in enumerate((_L, _N, _S), 1):
    _KIND[[ord(c) for c in re.findall(f"[{_class}]", "".join(map(chr, range(256))))]] = _k
#: Characters of a piece that two words of 64 bits hold with its length; the bytes of a word that the first 0 to 8 take.
SHORT = 15
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACED_WORD, _WORD, _NOTHING = re.compile(f" [{_L}]{{1,64}}"), re.compile(f"[{_L}]{{1,64}}"), re.compile("(?!)")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, by the installed package that holds them."""
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict = {}


def worker_encoder(name: str, most: int = 600_000) -> Encoder:
    """This worker process's encoder for a public tokenizer: later tasks find the pieces that earlier ones learnt."""
    if (name, most) not in _encoders:
        _encoders[name, most] = Encoder(vocabulary(name), most=most)
    return _encoders[name, most]


class _Codes(dict):
    """Piece -> code; a new piece gets the next code and waits in `pending` for its ids."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[str] = []
        self.given = 0

    def __missing__(self, piece: str) -> int:
        self[piece] = code = self.given
        self.given += 1
        self.pending.append(piece)
        return code


class _Short:
    """Codes of short Latin-1 pieces by their keys, in open addressing; a free slot has no length."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.used = bits, 0
        self.a, self.b, self.code = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The code of each key, -1 where it has none."""
        slot = self._slot(a, b)
        there = self.b[slot]
        hit = (there == b) & (self.a[slot] == a)
        out = np.where(hit, self.code[slot], np.int32(-1)).astype(np.int64)
        left = np.flatnonzero(~hit & (there != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.b) - 1)
            there = self.b[slot]
            hit = (there == b[left]) & (self.a[slot] == a[left])
            out[left[hit]] = self.code[slot[hit]]
            more = ~hit & (there != 0)
            left, slot = left[more], slot[more]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, code: np.ndarray) -> None:
        """Distinct keys that have no code yet."""
        if 2 * (self.used + len(a)) > len(self.b):
            full = self.b != 0
            a, b, code = (np.concatenate([x[full], y]) for x, y in ((self.a, a), (self.b, b), (self.code, code)))
            self.__init__(max(self.bits, (2 * len(a)).bit_length()))
        self.used += len(a)
        slot, left = self._slot(a, b), np.arange(len(a))
        while len(left):
            at = slot[left]
            free = self.b[at] == 0
            self.code[at[free]] = code[left[free]]
            won = free & (self.code[at] == code[left])  # one of those that want the same free slot
            self.a[at[won]], self.b[at[won]] = a[left[won]], b[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (len(self.b) - 1)


def _byte_level_starts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where `_BYTE_LEVEL` begins a piece in Latin-1 texts that lie one after the other, the k-th at offs[k]; raw ends with two bytes more at least."""
    n = int(offs[-1])
    kind = _KIND[raw[:n]]
    heads = offs[:-1][np.diff(offs) > 0]
    head, begin = np.zeros(n + 3, bool), np.ones(n + 3, bool)
    head[heads] = True
    begin[1:n] = (kind[1:] != kind[:-1]) | head[1:n]
    # The last white space before something else stands alone, or goes with it if it is a space.
    last = np.flatnonzero((kind[:-1] == _WHITE) & (kind[1:] != _WHITE) & ~head[1:n])
    begin[last] = True
    begin[last[raw[last] == 32] + 1] = False
    # A quote that begins a piece takes s, t, m, d, re, ve or ll with it.
    quote = np.flatnonzero(raw[: max(n - 1, 0)] == 39)
    quote = quote[begin[quote] & (kind[quote + 1] == _LETTER) & ~head[quote + 1]]
    c, d, single = raw[quote + 1], raw[quote + 2], begin[quote + 2]
    one = np.isin(c, np.frombuffer(b"stmd", np.uint8))
    two = ~single & (((d == ord("e")) & ((c == ord("r")) | (c == ord("v")))) | ((c == ord("l")) & (d == ord("l"))))
    begin[quote[one | two] + 1] = False
    begin[quote[one] + 2] = True
    begin[quote[two] + 3] = True
    return np.flatnonzero(begin[:n])


def _short_keys(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each piece and its length in two words of 64 bits; raw is a whole number of words and has two more than its texts."""
    words = raw.view("<u8")
    at, shift = starts >> 3, ((starts & 7) << 3).astype(np.uint64)
    back = np.uint64(63) - shift
    low, mid, high = words[at], words[at + 1], words[at + 2]
    a = ((low >> shift) | ((mid << np.uint64(1)) << back)) & _KEEP[np.minimum(lengths, 8)]
    b = ((mid >> shift) | ((high << np.uint64(1)) << back)) & _KEEP[np.clip(lengths - 8, 0, 7)]
    return a, b | (np.minimum(lengths, 255).astype(np.uint64) << np.uint64(56))


class Encoder:
    """Encode and decode as the tokenizers library does for one tokenizer file."""

    def __init__(self, path: str, long_text=None, most: int = MOST, long: int = LONG) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Which of the two public vocabularies' rules hold; any other tokenizer encodes whole texts.
        kind = str(self.tokenizer.pre_tokenizer)
        self.byte_level = kind.startswith("ByteLevel(add_prefix_space=False") and self.tokenizer.normalizer is None
        self.word_end = kind.startswith("Sequence") and "[^\\s\\p{L}\\p{N}]+" in kind and "Lowercase" in str(self.tokenizer.normalizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.joins = self.tokenizer.decoder is None  # the library then joins the tokens of all ids by a space
        self.long_text = long_text or self._plain
        self.most, self.long = most, long
        # Bytes of each token: a byte-level token's characters stand for a byte each.
        self.sizes = np.zeros(0, np.int64)
        if self.byte_level:
            known = self.tokenizer.get_vocab(with_added_tokens=False)
            self.sizes = np.zeros(max(known.values()) + 1, np.int64)
            self.sizes[list(known.values())] = list(map(len, known))
        self.clear()

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        self.codes, self.short = _Codes(), _Short()
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begins, self.lengths, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.decimal: list[str] = []
        self.decoded: list[str] = []

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of spaced byte-level words, and how many each has. SENTENCE words make one call of the library, where each is a pre-token; their bytes tell whose a token is."""
        rows = self.tokenizer.encode_batch_fast(["".join(words[k : k + SENTENCE]) for k in range(0, len(words), SENTENCE)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(r.ids for r in rows), np.uint32)
        after = np.cumsum([len(w.encode()) for w in words])
        ends = np.cumsum(self.sizes[ids])
        last = np.searchsorted(ends, after)
        if len(ends) == 0 or last[-1] != len(ends) - 1 or (ends[last] != after).any():
            raise ValueError("a word was cut otherwise than the split pattern says")
        return ids, np.diff(last, prepend=-1)

    def _rows(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece. Words are strung together, as many as SENTENCE in one call: each is a pre-token of its own there."""
        rows: list = [None] * len(pieces)
        plain = _WORD if self.word_end else _NOTHING
        words = [k for k, c in enumerate(pieces) if plain.fullmatch(c)]
        groups = [words[k : k + SENTENCE] for k in range(0, len(words), SENTENCE)]
        for group, encoding in zip(groups, self.tokenizer.encode_batch([" ".join(pieces[k] for k in g) for g in groups], add_special_tokens=False), strict=True):
            ids, cuts = encoding.ids, np.flatnonzero(np.diff(encoding.word_ids, prepend=-1)).tolist()
            if len(cuts) != len(group):
                raise ValueError("a word was cut otherwise than the split pattern says")
            for k, i, j in zip(group, cuts, [*cuts[1:], len(ids)], strict=True):
                rows[k] = ids[i:j]
        other = [k for k, r in enumerate(rows) if r is None and len(pieces[k]) <= self.long]
        for k, ids in zip(other, self._plain([pieces[k] for k in other]), strict=True):
            rows[k] = ids
        long = [k for k, r in enumerate(rows) if r is None]
        for k, ids in zip(long, self.long_text([pieces[k] for k in long]) if long else [], strict=True):
            rows[k] = ids
        return rows

    def _learn(self) -> None:
        pieces, self.codes.pending = self.codes.pending, []
        spaced = [k for k, c in enumerate(pieces) if _SPACED_WORD.fullmatch(c)] if self.byte_level else []
        ids, counts = self._spaced([pieces[k] for k in spaced]) if spaced else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        # The others' ids follow those of the spaced words.
        rest = np.setdiff1d(np.arange(len(pieces)), spaced, assume_unique=True)
        rows = self._rows([pieces[k] for k in rest])
        order = np.concatenate([np.array(spaced, np.int64), rest])
        lengths = np.concatenate([counts, np.fromiter(map(len, rows), np.int64, len(rows))])
        total, known = int(lengths.sum()), self.known + len(pieces)
        while self.used + total > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while known > len(self.begins):
            self.begins, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.lengths))
        self.store[self.used : self.used + len(ids)] = ids
        self.store[self.used + len(ids) : self.used + total] = np.fromiter(chain.from_iterable(rows), np.uint32, total - len(ids))
        self.lengths[self.known + order] = lengths
        self.begins[self.known + order] = self.used + np.cumsum(lengths) - lengths
        self.used, self.known = self.used + total, known

    def _digests(self) -> None:
        a = len(self.decimal)
        for k in range(a, self.known):
            ids = self.store[self.begins[k] : self.begins[k] + self.lengths[k]].tolist()
            self.decimal.append(" ".join(map(str, ids)))
            self.decoded.append(self.tokenizer.decode(ids, skip_special_tokens=False))

    def _cut(self, text: str) -> list[str]:
        if not (self.byte_level or self.word_end):
            return [text] if text else []
        if not _WIDE.search(text) and not any(s in text for s in self.special):
            return (_BYTE_LEVEL if self.byte_level else _WORD_END).findall(text)
        return [c for c in (_CUT if self.byte_level else _BREAK).split(text) if c]

    def _codes(self, texts: list[str]) -> list[list[int]]:
        """The piece codes of each text. The pieces of a step are looked up, and learnt, together."""
        if self.known > self.most:
            self.clear()
        code = self.codes.__getitem__
        found = [list(map(code, self._cut(t))) for t in texts]
        if self.codes.pending:
            self._learn()
        return found

    def _flat_codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`_codes` in one array, and how many each text has."""
        found = self._codes(texts)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts

    def _narrow_codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for byte-level Latin-1 texts without special tokens."""
        if self.known > self.most:
            self.clear()
        whole = "".join(texts)
        raw = np.frombuffer(whole.encode("latin-1") + bytes(24 - len(whole) % 8), np.uint8)
        offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        starts = _byte_level_starts(raw, offs)
        lengths = np.diff(starts, append=len(whole))
        a, b = _short_keys(raw, starts, lengths)
        codes = self.short.find(a, b)

        def pieces(at: np.ndarray) -> list[str]:
            return [whole[i : i + n] for i, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)]

        absent = np.flatnonzero(codes < 0)
        new, other = absent[lengths[absent] <= SHORT], absent[lengths[absent] > SHORT]
        codes[other] = list(map(self.codes.__getitem__, pieces(other)))
        if len(new):
            once = dict(zip(pieces(new), new.tolist(), strict=True))
            at = np.fromiter(once.values(), np.int64, len(once))
            self.codes.pending.extend(once)
            self.short.add(a[at], b[at], np.arange(self.codes.given, self.codes.given + len(at), dtype=np.int32))
            self.codes.given += len(at)
            codes[new] = self.short.find(a[new], b[new])
        if self.codes.pending:
            self._learn()
        return codes, np.diff(np.searchsorted(starts, offs))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the offsets of the texts in it."""
        narrow = np.array([self.byte_level and not _WIDE.search(t) and not any(s in t for s in self.special) for t in texts], bool)
        if narrow.all() or not narrow.any():
            return self._ids(*(self._narrow_codes if narrow.any() else self._flat_codes)(texts))
        parts = [self._ids(*of([t for t, x in zip(texts, narrow.tolist(), strict=True) if x == kind])) for kind, of in ((True, self._narrow_codes), (False, self._flat_codes))]
        sizes = np.zeros(len(texts), np.int64)
        sizes[narrow], sizes[~narrow] = (np.diff(offs) for _, offs in parts)
        ids, mine = np.zeros(int(sizes.sum()), np.uint32), np.repeat(narrow, sizes)
        ids[mine], ids[~mine] = (x for x, _ in parts)
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def _ids(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in one array, and the offsets in it of texts that have `counts` pieces each."""
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        ids = self.store[np.repeat(self.begins[codes] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, decimal ids joined by a space, decoded text) of each text."""
        if not self.joins:
            ids, offs = self.encode(texts)
            rows = [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            return [(len(r), " ".join(map(str, r)), self.tokenizer.decode(r, skip_special_tokens=False)) for r in rows]
        found, out = self._codes(texts), []
        self._digests()
        for codes in found:
            full = codes
            decimal = list(map(self.decimal.__getitem__, codes))
            if "" in decimal:
                full = [c for c in codes if self.lengths[c]]
                decimal = list(map(self.decimal.__getitem__, full))
            ids = " ".join(decimal)
            out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join(map(self.decoded.__getitem__, full))))
        return out
