"""Words of whole texts as 64-bit hashes, from the byte buffers of Arrow string arrays.

Everything is byte-parallel numpy over one Arrow buffer at a time: no Python
object per word or per text is made.  Bytes from 0x80 on belong to multi-byte
characters and are word bytes in every class used here, so UTF-8 needs no decoding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; bounds the temporary arrays.
BLOCK = 1 << 16

_rng = np.random.default_rng(20240917)
_byte = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15  # = 5 mod 8
_PINV = pow(_P, -1, 1 << 64)
_RING = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(4) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of anything but white space.
NON_SPACE = ~SPACE
#: Words are runs of ASCII digits, letters and bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_LOWER_HASH = _byte[LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        np.multiply(out[:step], np.uint64(pow(base, done, 1 << 64)), out=out[done : done + step])
        done += step
    return out


_up = _powers(_P, BLOCK + 1)
_down = _powers(_PINV, BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (in place where possible)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """Words of some texts: byte spans, hashes, and where each text's words begin."""

    buf: np.ndarray  # uint8, the texts one after another
    text_ptr: np.ndarray  # texts + 1 byte offsets
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray  # texts + 1 word offsets
    hash: np.ndarray  # uint64 of the lower-cased word

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.ptr)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ptr = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ptr[0] : ptr[-1]], ptr - ptr[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about ``most`` bytes of text (a longer text alone)."""
    _, ptr = buffers(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < len(ptr) - 1:
        j = max(i + 1, int(np.searchsorted(ptr, ptr[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _LOWER_HASH) -> np.ndarray:
    """A position-free polynomial hash of each byte span, mixed."""
    out = np.empty(len(start), np.uint64)
    long = np.flatnonzero(end - start > BLOCK)
    if len(long):
        keep = np.ones(len(start), bool)
        keep[long] = False
        out[keep] = word_hashes(buf, start[keep], end[keep], table)
        for k in long:
            word = LOWER[buf[start[k] : end[k]]].tobytes()
            out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out
    i = 0
    while i < len(start):
        base = start[i]
        j = int(np.searchsorted(end, base + BLOCK, side="right"))
        n = int(end[j - 1] - base)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        part = table.take(buf[base : base + n])
        part *= _down[:n]
        np.cumsum(part, out=sums[1:])
        s = start[i:j] - base
        h = sums[end[i:j] - base]
        h -= sums[s]
        h *= _up[s]
        out[i:j] = mix(h)
        i = j
    return out


def words(column: pa.Array, kind: np.ndarray = NON_SPACE, hashes: bool = True) -> Words:
    """The words of every text of the column; none spans two texts."""
    buf, text_ptr = buffers(column)
    inside = kind.take(buf)
    edge = np.empty(len(buf) + 1, bool)
    if len(buf):
        edge[0] = edge[-1] = True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edge[text_ptr] = True
        at = np.flatnonzero(edge)
        runs = inside[at[:-1]]
        start, end = at[:-1][runs], at[1:][runs]
    else:
        start = end = np.zeros(0, np.int64)
    ptr = np.searchsorted(start, text_ptr)
    return Words(buf, text_ptr, start, end, ptr, word_hashes(buf, start, end) if hashes else np.zeros(0, np.uint64))


def ngrams(hash_: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each position on (positions too near the end are left out)."""
    size = len(hash_) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = hash_[:size] * _RING[0]
    for k in range(1, n):
        out += hash_[k : k + size] * _RING[k]
    return mix(out)


def text_shingles(h: np.ndarray, n: int) -> np.ndarray:
    """The distinct ``n``-word shingles of one text, sorted; a shorter text is one shingle, none without words."""
    if len(h) == 0:
        return h
    if len(h) < n:
        short = h * _RING[32 : 32 + len(h)]
        return mix(short.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
    return np.unique(ngrams(h, n))
