"""Vectorised word splitting and hashing over Arrow string columns.

Everything here works on bytes: the words that the operators use are runs of
bytes outside a separator set, so UTF-8 never has to be decoded. Words that
must be told apart exactly are hashed by a keyed function of their bytes to 128
bits (SipHash with one round a block and three at the end; BLAKE2b for words
beyond LONG_WORD bytes); hashes of word windows are trees of non-linear joins
over these, so no text collides by algebra.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_STEP = 1 << 18  # bytes or words hashed at a time, so that temporaries stay in cache
_MASK = (1 << 64) - 1
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_KEY = b"words of a text."
#: Bytes beyond which a word is hashed by itself.
LONG_WORD = 256
_JOIN = (np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7))

#: Separators of ``[^\x20\x09-\x0D]+``.
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, _STEP + 64), base & _MASK, dtype=np.uint64)
        full[0] = 1
        have = _powers[base] = np.cumprod(full, dtype=np.uint64)
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a column of texts: byte ranges into ``data``; document d has words first[d]:first[d+1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    inside: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document_end(self) -> np.ndarray:
        """For each word the index after the last word of its document."""
        return np.repeat(self.first[1:], self.counts)

    def document_start(self) -> np.ndarray:
        return np.repeat(self.first[:-1], self.counts)

    def column(self) -> pa.Array:
        """The words as a binary column."""
        offsets = np.zeros(len(self) + 1, dtype=np.int64)
        np.cumsum(self.end - self.start, out=offsets[1:])
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[self.inside])])

    def text(self, d: int) -> bytes:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()


def split_words(texts, is_word: np.ndarray = SPACE_WORD, lower: bool = False) -> Words:
    """Split each text (null: empty) into maximal runs of word bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    _, off, raw = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    inside = is_word[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    before[:-1] = inside[1:]
    before[-1:] = False
    before[offsets[1:][offsets[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~before) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), inside)


def _rotate(x: np.ndarray, by: int, spare: np.ndarray) -> None:
    np.right_shift(x, np.uint64(64 - by), out=spare)
    x <<= np.uint64(by)
    x |= spare


def _sip_rounds(v: list[np.ndarray], times: int) -> None:
    a, b, c, d = v
    spare = np.empty_like(a)
    for _ in range(times):
        a += b
        _rotate(b, 13, spare)
        b ^= a
        _rotate(a, 32, spare)
        c += d
        _rotate(d, 16, spare)
        d ^= c
        a += d
        _rotate(d, 21, spare)
        d ^= a
        c += b
        _rotate(b, 17, spare)
        b ^= c
        _rotate(c, 32, spare)


def _sip(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Halves of the 128-bit hash of byte ranges; eight readable bytes follow each range."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    keys = np.frombuffer(_KEY, "<u8")
    # The function's initial state.
    state = [np.full(len(start), keys[i & 1] ^ np.uint64(c)) for i, c in enumerate((0x736F6D6570736575, 0x646F72616E646F6D ^ 0xEE, 0x6C7967656E657261, 0x7465646279746573))]

    def absorb(v, m):
        v[3] ^= m
        _sip_rounds(v, 1)
        v[0] ^= m

    blocks = size >> 3
    for b in range(int(blocks.max(initial=0))):
        at = np.flatnonzero(blocks > b)
        part = [x[at] for x in state]
        absorb(part, eight[start[at] + 8 * b])
        for x, y in zip(state, part):
            x[at] = y
    rest = (size & 7).astype(np.uint64)
    absorb(state, eight[start + 8 * blocks] & ((np.uint64(1) << (rest << np.uint64(3))) - np.uint64(1)) | size.astype(np.uint64) << np.uint64(56))
    state[2] ^= np.uint64(0xEE)
    _sip_rounds(state, 3)
    first = state[0] ^ state[1] ^ state[2] ^ state[3]
    state[1] ^= np.uint64(0xDD)
    _sip_rounds(state, 3)
    return first, state[0] ^ state[1] ^ state[2] ^ state[3]


def word_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit keyed hash of each word's bytes, as two halves."""
    halves = np.empty(len(w), dtype=np.uint64), np.empty(len(w), dtype=np.uint64)
    data = np.concatenate([w.data, np.zeros(16, np.uint8)])
    size = w.end - w.start
    for i in range(0, len(w), _STEP >> 4):
        j = min(len(w), i + (_STEP >> 4))
        for half, got in zip(halves, _sip(data, w.start[i:j], np.minimum(size[i:j], LONG_WORD))):
            half[i:j] = got
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(w.data[w.start[i] : w.end[i]].tobytes(), digest_size=16, key=_KEY).digest()
        halves[0][i], halves[1][i] = np.frombuffer(digest, "<u8")
    return halves


def feature_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, the one that stem_hashes gives; for model features, whose collisions do no harm."""
    return _hashes(w, (None,))[0]


def stem_hashes(w: Words, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of each whole word and of its first so many bytes; a stem as long as its word or longer is that word's."""
    return _hashes(w, (None, *lengths))


def _hashes(w: Words, lengths) -> list[np.ndarray]:
    outs = [np.empty(len(w), dtype=np.uint64) for _ in lengths]
    i = 0
    while i < len(w):
        low = w.start[i]
        j = max(i + 1, int(np.searchsorted(w.end, low + _STEP, "right")))
        high = int(w.end[j - 1])
        part = w.data[low:high].astype(np.uint64)
        part += np.uint64(1)
        part *= _power(BYTE_BASE, high - low)
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(part, out=total[1:])
        s, e = w.start[i:j] - low, w.end[i:j] - low
        head, shift = total[s], _power(_inverse(BYTE_BASE), high - low)[s]
        for out, k in zip(outs, lengths):
            stop = e if k is None else np.minimum(e, s + k)
            out[i:j] = (total[stop] - head) * shift
            out[i:j] += (stop - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        i = j
    return [mix(out) for out in outs]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs in order; one-to-one in each part while the other is fixed."""
    t = a * _JOIN[0]
    t ^= t >> np.uint64(32)
    t += b
    t *= _JOIN[1]
    t ^= t >> np.uint64(29)
    return t


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive values; windows that cross documents are the caller's to drop.

    A window is joined from runs of 1, 2, 4, ... values, each the join of two
    runs of half its length.
    """
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    step = _STEP >> 3
    for i in range(0, n, step):
        m = min(n - i, step)
        run, size, used, total = values[i : i + m + k - 1], 1, 0, None
        while True:
            if k & size:
                part = run[used : used + m]
                total = part.copy() if total is None else _joined(total, part)
                used += size
            if 2 * size > k:
                break
            run = _joined(run[:-size], run[size:])
            size *= 2
        out[i : i + m] = total
    out += np.uint64(k)
    return mix(out)
