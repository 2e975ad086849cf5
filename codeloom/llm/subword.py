"""Subword encoding of whole text columns with the ``tokenizers`` library.

Byte-pair encoders work inside pre-tokens, and the pre-tokenisers of the
supported files always break before a single space that follows a
non-white-space character, before most signs after a letter or digit, and after a single
line break.  A text is therefore the concatenation of chunks ``"word"``,
``" word"``, ``","`` ... that can be encoded one by one.  Corpora repeat
their chunks, so each Python worker keeps a bounded table of chunks it has
seen; only new chunks reach the tokenizer.  A hit needs equal hash, length,
first eight and last eight bytes: up to 16 bytes that is the whole chunk.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
from codeloom.llm.bytewords import _POW, U64, mix, seeds, slices
from codeloom.llm.worker import resource
from tokenizers import Tokenizer

_SLOTS = 1 << 20
_ARENA = 1 << 23
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14), *range(28, 32)]] = True
_VISIBLE_ASCII = np.zeros(256, dtype=bool)
_VISIBLE_ASCII[33:127] = True
_WORDLIKE = np.zeros(256, dtype=bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SIGN = _VISIBLE_ASCII & ~_WORDLIKE
_SIGN[[39, 124]] = False  # apostrophes begin contractions, bars stand in special tokens
_VALUE = seeds(256, 3)
_LONGEST = 64  # longer chunks are not kept


@dataclass
class Encoded:
    """Token ids of some documents, one after another."""

    ids: np.ndarray  # uint32
    bounds: np.ndarray  # ids of document i: bounds[i] .. bounds[i + 1]


def chunk_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where chunks begin: at documents, and before spaces at which encoders always break."""
    if not len(buf):
        return np.zeros(0, dtype=np.int64)
    cut = np.zeros(len(buf), dtype=bool)
    at = np.flatnonzero(buf == 32)
    at = at[(at > 1) & (at + 1 < len(buf))]
    prev, nxt, lead = buf[at - 1], buf[at + 1], buf[at - 2]
    after_ascii = _VISIBLE_ASCII[prev]
    after_letter = (prev >= 128) & (_VISIBLE_ASCII[nxt] | ((lead >= 0xC3) & (lead <= 0xDF)))
    cut[at[after_ascii | after_letter]] = True
    # a sign after an ASCII letter or digit begins a pre-token
    cut[1:] |= _SIGN[buf[1:]] & _WORDLIKE[buf[:-1]]
    # so does what follows a single line break
    at = np.flatnonzero(buf[1:-1] == 10) + 2 if len(buf) > 2 else at[:0]
    nxt = buf[at]
    cut[at[_VISIBLE_ASCII[buf[at - 2]] & (_VISIBLE_ASCII[nxt] | ((nxt >= 0xC3) & (nxt <= 0xDF)))]] = True
    # a document's edge is no neighbour: what is next to it stays in its chunk
    edge = offs[(offs < len(buf))]
    for near in (1, 2, -1):
        side = edge + near
        cut[side[(side > 0) & (side < len(buf))]] = False
    cut[edge] = True
    return np.flatnonzero(cut)


class ChunkEncoder:
    """Encodes documents chunk by chunk with a bounded table of known chunks."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.fence = self._find_fence()
        self._reset()

    def _find_fence(self) -> tuple[str, int] | None:
        """A string that is always one token of its own between chunks, and that token.

        Many short chunks joined by it cost one call and one result object.
        """
        probes = ["ab", " cd", "'s", " 12", " é.", "!", " x!"]
        alone = [e.ids for e in self.tokenizer.encode_batch_fast(probes, add_special_tokens=False)]
        for text in ("\n", " 0 "):
            mark = self.tokenizer.encode(text, add_special_tokens=False).ids
            if len(mark) == 1 and text.strip() not in "".join(probes).split() and self._split(probes, text, mark[0]) == alone:
                return text, mark[0]
        return None

    def _split(self, chunks: list[str], text: str, mark: int) -> list[list[int]]:
        ids = self.tokenizer.encode_batch_fast([text.join(chunks)], add_special_tokens=False)[0].ids
        out, at = [], 0
        for _ in range(len(chunks) - 1):
            stop = ids.index(mark, at)
            out.append(ids[at:stop])
            at = stop + 1
        return [*out, ids[at:]]

    def _reset(self) -> None:
        self.key = np.zeros((_SLOTS, 2), dtype=U64)
        self.head = np.zeros((_SLOTS, 2), dtype=U64)
        self.tail = np.zeros((_SLOTS, 2), dtype=U64)
        self.place = np.zeros((_SLOTS, 2), dtype=np.int64)  # begin in the arena << 28 | number of ids
        self.arena = np.zeros(1 << 16, dtype=np.uint32)
        self.filled = 0

    def _store(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Put runs of ``n`` ids into the arena; return their places."""
        while self.filled + len(ids) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
        begin = self.filled + np.cumsum(n) - n
        self.arena[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        return (begin << 28) | n

    def _encode_new(self, chunks: list[str]) -> np.ndarray:
        """Encode chunks that the table lacks; return their places in the arena."""
        place = np.zeros(len(chunks), dtype=np.int64)
        rest = list(range(len(chunks)))
        if self.fence is not None:
            text, mark = self.fence
            core = text.strip() or text
            plain = [i for i, c in enumerate(chunks) if core not in c and len(c) <= _LONGEST and c.isprintable() and c[-1] != " "]
            for lo in range(0, len(plain), 4096):
                part = plain[lo : lo + 4096]
                joined = text.join([chunks[i] for i in part])
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int64)
                at = np.concatenate([[-1], np.flatnonzero(ids == mark), [len(ids)]])
                place[part] = self._store(ids[ids != mark], np.diff(at) - 1)
            known = set(plain)
            rest = [i for i in rest if i not in known]
        got = [np.array(e.ids, dtype=np.int64) for e in self.tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False)]
        if got:
            place[rest] = self._store(np.concatenate(got), np.array([len(x) for x in got], dtype=np.int64))
        return place

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> Encoded:
        """Ids of every document between consecutive ``offs``; long inputs go piece by piece."""
        parts, counts = [], np.zeros(len(offs) - 1, dtype=np.int64)
        for i, j in slices(offs, 1 << 20):
            got = self._slice(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            parts.append(got.ids)
            counts[i:j] = np.diff(got.bounds)
        return Encoded(np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))

    def _slice(self, buf: np.ndarray, offs: np.ndarray) -> Encoded:
        if self.filled > _ARENA:
            self._reset()
        start = chunk_starts(buf, offs)
        if not len(start):
            return Encoded(np.zeros(0, dtype=np.uint32), np.zeros(len(offs), dtype=np.int64))
        end = np.append(start[1:], len(buf))
        size = end - start
        h = self._hashes(buf, start, end)
        padded = np.concatenate([np.zeros(8, dtype=np.uint8), buf, np.zeros(8, dtype=np.uint8)])
        view = np.lib.stride_tricks.as_strided(padded[: len(padded) - 7].view(np.uint8), shape=(len(padded) - 7, 8), strides=(1, 1))
        short = np.minimum(size, 8)
        mask = np.where(short == 8, ~U64(0), (U64(1) << (short.astype(U64) * U64(8))) - U64(1))
        head = np.ascontiguousarray(view[start + 8]).view(U64).ravel() & mask
        tail = np.ascontiguousarray(view[end]).view(U64).ravel() >> ((U64(8) - short.astype(U64)) * U64(8))
        del padded, view
        slot = (h & U64(_SLOTS - 1)).astype(np.int64)
        place = np.full(len(start), -1, dtype=np.int64)
        for way in (0, 1):
            hit = (self.key[slot, way] == h) & (self.head[slot, way] == head) & (self.tail[slot, way] == tail)
            place[hit] = self.place[slot[hit], way]
        miss = np.flatnonzero(place < 0)
        if len(miss):
            brief = miss[size[miss] <= _LONGEST]
            triple = np.stack([h[brief], head[brief], tail[brief]], axis=1)
            order = np.lexsort((triple[:, 2], triple[:, 1], triple[:, 0])) if len(brief) else np.zeros(0, dtype=np.int64)
            new = np.ones(len(brief), dtype=bool)
            ranked = triple[order]
            new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
            firsts = brief[order[new]] if len(brief) else brief
            long = miss[size[miss] > _LONGEST]
            todo = np.concatenate([firsts, long])
            raw = buf.tobytes()
            kept = self._encode_new([raw[s:e].decode() for s, e in zip(start[todo].tolist(), end[todo].tolist(), strict=True)])
            if len(brief):
                place[brief[order]] = kept[: len(firsts)][np.cumsum(new) - 1]
                s = slot[firsts]
                self.key[s, 1], self.head[s, 1], self.tail[s, 1], self.place[s, 1] = self.key[s, 0], self.head[s, 0], self.tail[s, 0], self.place[s, 0]
                self.key[s, 0], self.head[s, 0], self.tail[s, 0], self.place[s, 0] = h[firsts], head[firsts], tail[firsts], kept[: len(firsts)]
            place[long] = kept[len(firsts) :]
        n, begin = place & 0xFFFFFFF, place >> 28
        at = np.cumsum(n) - n
        ids = self.arena[np.repeat(begin - at, n) + np.arange(int(n.sum()))]
        per_doc = np.searchsorted(start, offs)
        return Encoded(ids, np.append(at, int(n.sum()))[per_doc])

    @staticmethod
    def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), dtype=U64)
        i = 0
        while i < len(start):  # runs of chunks of about half a MB
            j = max(i + 1, int(np.searchsorted(start, start[i] + (1 << 19))))
            lo, hi = int(start[i]), int(end[j - 1])
            up, down = _POW.get(hi - lo)
            v = _VALUE[buf[lo:hi]] * up[: hi - lo]
            s, e = start[i:j] - lo, end[i:j] - lo
            first = v[s]
            np.cumsum(v, out=v)
            out[i:j] = (v[e - 1] - v[s] + first) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
            i = j
        return mix(out)


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file."""
    return resource(("encoder", path), lambda: ChunkEncoder(path))


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
