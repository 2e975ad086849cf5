"""Vectorised tokenisation of Arrow string columns at the level of UTF-8 bytes.

All text operators that need words work on the column's own buffers: a byte
class table says which bytes belong to words (every byte of a multi-byte
character does), and each word gets a 64-bit polynomial hash of its bytes from
one running sum.  No Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (the splitmix64 one)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit words."""
    base = (np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) + U64(salt * 0x632BE59BD9B4E019 % (1 << 64))
    return mix(base) | U64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=U64)


class _Powers:
    """Powers of the hash base and of its inverse, grown when a piece is longer."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, n), _powers(_BASE_INV, n)
        return self.up, self.down


_POW = _Powers()


@dataclass(frozen=True)
class WordSpec:
    """Which bytes make words, and the hash value of each byte."""

    member: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(member: np.ndarray, fold_case: bool = True) -> WordSpec:
        value = seeds(256, 7)
        if fold_case:
            value[65:91] = value[97:123]
        return WordSpec(member, value)


def _alnum() -> np.ndarray:
    member = np.zeros(256, dtype=bool)
    for lo, hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
        member[lo : hi + 1] = True
    return member


def _visible() -> np.ndarray:
    member = np.ones(256, dtype=bool)
    member[[32, *range(9, 14)]] = False
    return member


#: Words of letters, digits and non-ASCII characters, A-Z folded.
ALNUM = WordSpec.of(_alnum())
#: Words of anything but space, tab, LF, VT, FF and CR, A-Z folded.
VISIBLE = WordSpec.of(_visible())


@dataclass
class Words:
    """Words of some documents: byte spans, hashes and the first word of each document."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first[i] .. first[i + 1] are the words of document i

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary()) if not pa.types.is_string(column.type) else column.cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``limit`` bytes each; a longer document is a range of its own."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def _pieces(buf: np.ndarray, offs: np.ndarray, member: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of bounded length that cut no word, unless a single word is longer."""
    n, lo = len(buf), 0
    while lo < n:
        hi = min(n, lo + _PIECE)
        if hi < n:
            k = int(np.searchsorted(offs, hi, side="right")) - 1
            if offs[k] > lo:
                hi = int(offs[k])
            else:
                back = np.flatnonzero(~member[buf[lo:hi]])
                if len(back):
                    hi = lo + int(back[-1]) + 1
                else:  # one long word: up to its end
                    stop = int(offs[k + 1])
                    more = np.flatnonzero(~member[buf[hi:stop]])
                    hi = hi + int(more[0]) if len(more) else stop
        yield lo, hi
        lo = hi


#: Lead bytes of characters that ``written_words`` looks at: 1 two bytes, 2 punctuation, 3 unspaced, 4 partly, 5 four bytes.
_LEAD = np.zeros(256, dtype=np.uint8)
_LEAD[0xC2], _LEAD[0xE2], _LEAD[0xE3:0xEA], _LEAD[[0xE0, 0xE1, 0xEF]], _LEAD[0xF0] = 1, 2, 3, 4, 5


def written_words(buf: np.ndarray, offs: np.ndarray) -> Words:
    """Words as ``ALNUM`` has them, but parted by punctuation beyond ASCII, and by script.

    Quotation marks, dashes and spaces of the Latin-1, general, CJK and fullwidth blocks part words.
    In scripts that put no spaces between words (Han, Kana, Thai, Lao, Burmese, Khmer), each character is a word.
    """
    n = len(buf)
    at = np.flatnonzero(_LEAD[buf])
    at = at[at + 1 < n]
    if not len(at):
        return words(buf, offs, ALNUM)
    kind, second = _LEAD[buf[at]], buf[at + 1]
    third = buf[np.minimum(at + 2, n - 1)]
    latin = (kind == 1) & ~np.isin(second, (0xAA, 0xB5, 0xBA))
    wide = (buf[at] == 0xEF) & ((second == 0xBC) & ((third < 0x90) | (third >= 0x9A) & (third < 0xA1) | (third >= 0xBB)) | (second == 0xBD) & ((third == 0x80) | (third >= 0x9B) & (third < 0xA6)))
    marks = (kind == 2) & (second < 0x82) | (buf[at] == 0xE3) & (second == 0x80) | wide
    lone = (kind == 3) & ~marks | (buf[at] == 0xE0) & (second >= 0xB8) & (second < 0xBC) | (buf[at] == 0xE1) & ((second < 0x83) | (second == 0x9E) | (second == 0x9F))
    lone4 = (kind == 5) & (second >= 0xA0) & (second < 0xB0)
    if latin.any() or marks.any():
        buf = buf.copy()
        for places, size in ((at[latin], 2), (at[marks], 3)):
            for k in range(size):
                buf[np.minimum(places + k, n - 1)] = 32
    breaks = np.unique(np.concatenate([at[lone], at[lone] + 3, at[lone4], at[lone4] + 4]))
    return words(buf, offs, ALNUM, breaks[breaks < n])


def words(buf: np.ndarray, offs: np.ndarray, spec: WordSpec, breaks: np.ndarray | None = None) -> Words:
    """Words of the documents in ``buf`` between consecutive ``offs``; also cut before the bytes ``breaks``, if given."""
    starts, ends, hashes = [], [], []
    cuts = offs[1:-1]
    for lo, hi in _pieces(buf, offs, spec.member):
        part = buf[lo:hi]
        m = spec.member[part]
        before = np.empty_like(m)
        before[0] = False
        before[1:] = m[:-1]
        after = np.empty_like(m)
        after[-1] = False
        after[:-1] = m[1:]
        a, b = np.searchsorted(cuts, [lo, hi])
        inner = cuts[a:b] - lo
        before[inner] = False
        after[inner[inner > 0] - 1] = False
        if breaks is not None:
            a, b = np.searchsorted(breaks, [lo, hi])
            inner = breaks[a:b] - lo
            before[inner] = False
            after[inner[inner > 0] - 1] = False
        s = np.flatnonzero(m & ~before)
        if not len(s):
            continue
        e = np.flatnonzero(m & ~after) + 1
        up, down = _POW.get(hi - lo)
        v = spec.value[part]
        v *= up[: hi - lo]
        first = v[s]
        np.cumsum(v, out=v)
        h = (v[e - 1] - v[s] + first) * down[s]
        h += (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(mix(h))
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none.astype(U64), np.zeros(len(offs), dtype=np.int64))
    start = np.concatenate(starts)
    return Words(start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, offs))


def hash_words(terms: list[str], spec: WordSpec) -> np.ndarray:
    """Hashes of single words as ``words`` gives them; each term must be one word."""
    data = [t.encode() for t in terms]
    offs = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    got = words(np.frombuffer(b"".join(data), dtype=np.uint8), offs, spec)
    if len(got.hash) != len(terms):
        raise ValueError("a term is not exactly one word")
    return got.hash


def combine(parts: list[np.ndarray], salt: int) -> np.ndarray:
    """One hash of several aligned hash arrays; their order counts."""
    coef = seeds(len(parts), salt)
    out = np.zeros(len(parts[0]), dtype=U64)
    for c, p in zip(coef, parts, strict=True):
        out += p * c
    return mix(out + U64(len(parts)))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document's ``k``-word shingles, and their bounds.

    A document of fewer words, but not none, has one shingle: all its words.
    """
    n = np.diff(w.first)
    size = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.empty(int(at[-1]), dtype=U64)
    if len(w.hash) >= k:
        rolling = combine([w.hash[i : len(w.hash) - k + 1 + i] for i in range(k)], 11)
        long = np.flatnonzero(n >= k)
        src = np.repeat(w.first[long] - at[long], size[long])
        pos = np.repeat(n >= k, size)
        dst = np.flatnonzero(pos)
        out[dst] = rolling[dst + src]
    for short in range(1, k):
        docs = np.flatnonzero(n == short)
        if len(docs):
            out[at[docs]] = combine([w.hash[w.first[docs] + i] for i in range(short)], 11)
    keep, bounds = [], np.zeros(len(at), dtype=np.int64)
    for i in range(len(n)):
        u = np.sort(out[at[i] : at[i + 1]])
        if len(u) > 1:
            u = u[np.concatenate([[True], u[1:] != u[:-1]])]
        keep.append(u)
        bounds[i + 1] = bounds[i] + len(u)
    return (np.concatenate(keep) if keep else out), bounds
