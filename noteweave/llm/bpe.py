"""Byte-level BPE ids of whole texts, through the tokenizers library.

The library spends most of its time on words that it has met before.  Here numpy cuts a
chunk of texts into the pre-tokens of the byte-level pattern, a hash table in numpy
finds those that this Python worker has met, and only new pre-tokens go through the
library's own BPE model.  The ids equal those of
`Tokenizer.encode(text, add_special_tokens=False)`.  Texts with characters beyond the
basic plane, and those that hold the string of an added token, go through the library
whole.  The table finds a pre-token by a hash and then compares its characters, so a
collision costs a call of the model and never gives wrong ids.  The table is emptied when
it is full, so memory is bounded; a pre-token longer than `LONG_WORD` is never kept.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator, Sequence

import numpy as np

from .common import RollingHash, mix64, ranges, runs_of

LETTER, NUMBER, OTHER, SPACE, NONE = 0, 1, 2, 3, 255
CHUNK_CHARS = 1 << 20
TABLE_BITS = 20
#: Characters of the longest pre-token that the table keeps.
LONG_WORD = 256
#: Characters that the table holds before it is emptied.
POOL_CHARS = 1 << 24
#: The contractions of the byte-level pattern.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@functools.cache
def char_classes() -> np.ndarray:
    """Class of each code point of the basic plane."""
    import regex

    out = np.full(0x10000, OTHER, np.uint8)
    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = "".join(regex.findall(pattern, text))
        out[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    return out


@functools.cache
def _byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies use for each byte: printable
    Latin-1 characters stand for themselves, the others for 256, 257, ... in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pretoken_starts(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Start of each pre-token; cp: code points of texts end to end, none of them empty."""
    n = len(cp)
    kind = char_classes()[cp]
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    before[doc_starts] = NONE
    after = np.empty(n, np.uint8)
    after[:-1] = kind[1:]
    after[doc_starts[1:] - 1] = NONE
    after[-1] = NONE
    blank = cp == 0x20
    led = np.empty(n, bool)  # a blank stands before it, which it takes along
    led[1:] = blank[:-1]
    led[doc_starts] = False
    space = kind == SPACE
    cut = np.where(
        space,
        (before != SPACE) | ((after != SPACE) & (after != NONE)),
        (before != kind) & ~led,
    )
    quotes = np.flatnonzero(cp == 0x27)
    quotes = quotes[(before[quotes] != OTHER) & ~led[quotes] & (after[quotes] == LETTER)]
    if len(quotes):
        nxt = cp[quotes + 1]
        # The letter after next counts only inside the same text.
        third = np.where(after[quotes + 1] == LETTER, cp[np.minimum(quotes + 2, n - 1)], 0)
        length = np.zeros(len(quotes), np.int64)
        for c in CONTRACTIONS:
            hit = nxt == ord(c[1])
            if len(c) == 3:
                hit &= third == ord(c[2])
            length[hit] = len(c)
        quotes, length = quotes[length > 0], length[length > 0]
        cut[quotes + 1] = False
        ends = quotes + length
        cut[ends[ends < n]] = True
    return np.flatnonzero(cut)


class _Runs:
    """Pre-tokens as runs of code points in one growing array."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 18, np.uint16), 0
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, chars: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(chars) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(chars)] = chars
        self.start = np.concatenate((self.start, self.used + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes.astype(np.int32)))
        self.used += len(chars)

    def differ(self, words: np.ndarray, cp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which words (numbers) are not the runs of cp at starts."""
        odd = self.size[words] != sizes
        same = np.flatnonzero(~odd)
        n = sizes[same]
        bad = self.flat[ranges(self.start[words[same]], n)] != cp[ranges(starts[same], n)]
        if bad.any():
            odd[same[np.unique(np.searchsorted(np.cumsum(n), np.flatnonzero(bad), side="right"))]] = True
        return np.flatnonzero(odd)


class _Table:
    """Open addressing from pre-token hashes to runs of ids in a pool, with the characters
    of each pre-token in a second pool."""

    def __init__(self, bits: int = TABLE_BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.vals = np.zeros(1 << bits, np.int32)
        self.room = (1 << bits) * 5 // 8
        self.n = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint16)
        self.used = 0
        self.chars = _Runs()

    def find(self, h: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for new ones."""
        at = (h & self.mask).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.vals[at], np.int32(-1))
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            at[left] = (at[left] + 1) & int(self.mask)
            key = self.keys[at[left]]
            hit = key == h[left]
            out[left[hit]] = self.vals[at[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, words: list[Sequence[int]], chars: np.ndarray, sizes: np.ndarray) -> None:
        """h: distinct and new; chars: the pre-tokens' code points end to end, with their sizes."""
        self.chars.add(chars, sizes)
        n, lengths = len(h), np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter((i for w in words for i in w), np.int64, int(lengths.sum()))
        if flat.size and flat.max() > 0xFFFF and self.pool.dtype == np.uint16:
            self.pool = self.pool.astype(np.uint32)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while self.n + n > len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
            self.length = np.concatenate((self.length, np.zeros_like(self.length)))
        self.pool[self.used : self.used + len(flat)] = flat
        number = np.arange(self.n, self.n + n)
        self.start[number] = self.used + np.cumsum(lengths) - lengths
        self.length[number] = lengths
        self.used += len(flat)
        self.n += n
        at, left = (h & self.mask).astype(np.int64), np.arange(n)
        while len(left):
            free = self.keys[at[left]] == 0
            cand = left[free]
            _, first = np.unique(at[cand], return_index=True)
            won = cand[first]
            self.keys[at[won]] = h[won]
            self.vals[at[won]] = number[won]
            taken = np.zeros(n, bool)
            taken[won] = True
            left = left[~taken[left]]
            at[left] = (at[left] + 1) & int(self.mask)


class ByteBpe:
    """Ids of texts; one object for each Python worker and tokenizer file."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.table = _Table()
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        letters = _byte_letters()
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))] for w in words]

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end, and how many each text has."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        counts = np.zeros(len(texts), np.int64)
        if not joined:
            return np.zeros(0, np.uint32), counts
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        full = np.flatnonzero(lengths)
        doc_starts = (np.cumsum(lengths) - lengths)[full]
        starts = pretoken_starts(cp, doc_starts)
        ends = np.append(starts[1:], len(cp))
        length = ends - starts
        h = RollingHash(mix64(cp.astype(np.uint64) + np.uint64(1))).slices(starts, ends)
        h[h == 0] = 1
        kept = np.flatnonzero(length <= LONG_WORD)
        words = np.full(len(h), -1, np.int32)
        words[kept] = self.table.find(h[kept])
        new = kept[words[kept] < 0]
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            if self.table.n + len(fresh) > self.table.room or self.table.chars.used > POOL_CHARS:
                self.table = _Table(max(TABLE_BITS, int(len(h) * 2).bit_length()))
                fresh, first = np.unique(h[kept], return_index=True)
                new = kept
            at = new[first]
            made = self._encode_words([joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            self.table.add(fresh, made, cp[ranges(starts[at], length[at])], length[at])
            words[new] = self.table.find(h[new])
        odd = kept[self.table.chars.differ(words[kept], cp, starts[kept], length[kept])]
        odd = np.sort(np.concatenate((odd, np.flatnonzero(length > LONG_WORD))))
        words[odd] = 0
        sizes = self.table.length[words].astype(np.int64)
        if len(odd):  # those that the table does not hold
            made = self._encode_words([joined[a:b] for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)])
            sizes[odd] = [len(w) for w in made]
            ids = np.zeros(int(sizes.sum()), np.uint32)
            held = np.ones(len(words), bool)
            held[odd] = False
            place = np.cumsum(sizes) - sizes
            own = ranges(self.table.start[words[held]], sizes[held])
            ids[ranges(place[held], sizes[held])] = self.table.pool[own]
            ids[ranges(place[odd], sizes[odd])] = [i for w in made for i in w]
        else:
            ids = self.table.pool[ranges(self.table.start[words], sizes)].astype(np.uint32)
        before = np.concatenate(([0], np.cumsum(sizes)))
        edges = np.append(np.searchsorted(starts, doc_starts), len(starts))
        counts[full] = before[edges[1:]] - before[edges[:-1]]
        return ids, counts

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids (uint32) of each text in turn."""
        odd = [(not t.isascii() and max(t) > "￿") or any(x in t for x in self.added) for t in texts]
        plain = ["" if o else t for t, o in zip(texts, odd, strict=True)]
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        for a, b in runs_of(sizes, CHUNK_CHARS):
            ids, counts = self._chunk(plain[a:b])
            ends = np.cumsum(counts)
            for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True), a):
                if odd[i]:
                    yield np.asarray(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                else:
                    yield ids[end - n : end]


@functools.cache
def worker_bpe(path: str) -> ByteBpe:
    """The tokenizer that all tasks of this Python worker share."""
    return ByteBpe(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def little_endian(ids: np.ndarray) -> np.ndarray:
    return ids if sys.byteorder == "little" else ids.astype("<u4")
