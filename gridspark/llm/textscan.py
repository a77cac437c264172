"""Vectorised word scanning of Arrow string columns, for use inside ``mapInArrow`` tasks.

A batch of texts is one byte buffer; words, word hashes and shingle hashes come from numpy passes over it, in slices
of bounded size. All separators used here are ASCII, so byte positions split UTF-8 correctly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20
LONG_WORD = 4096

_byte = np.arange(256)
#: Word bytes of ``[^\x20\x09-\x0D]+``.
BLANK_SEPARATED = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after A-Z have become a-z.
ALPHANUMERIC = ~((_byte <= 0x2F) | ((_byte >= 0x3A) & (_byte <= 0x60)) | ((_byte >= 0x7B) & (_byte <= 0x7F)))
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)

_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a slice of texts. ``ptr[d]:ptr[d + 1]`` are the words of text d; ``data`` is padded by 8 bytes."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends - self.starts)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; null texts are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, past last, bytes, offsets) for runs of texts of about ``limit`` bytes; a longer text is a run alone."""
    raw, off = buffers(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield at, to, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def scan(raw: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray, lower: bool = True) -> Words:
    n = len(raw)
    data = np.zeros(n + 8, np.uint8)
    data[:n] = LOWER[raw] if lower else raw
    inside = np.zeros(n + 1, bool)
    inside[:n] = word_byte[data[:n]]
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1] if n > 1 else first[1:]
    last = inside[:n] & ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word, read eight bytes at a time."""
    if not len(starts):
        return np.empty(0, np.uint64)
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = mix((eight[starts] & _MASK[np.minimum(lengths, 8)]) * _ODD[0] + lengths.astype(np.uint64) * _ODD[1])
    at, k = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD)), 8
    while len(at):
        block = eight[starts[at] + k] & _MASK[np.minimum(lengths[at] - k, 8)]
        h[at] = mix(h[at] * _ODD[2] + block)
        k += 8
        at = at[lengths[at] > k]
    for i in np.flatnonzero(lengths > LONG_WORD):
        h[i] = np.uint64(xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]].tobytes()))
    return h


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions have none."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out + h[j : j + n]) * _ODD[j % 5]
        out ^= out >> np.uint64(32)
    return mix(out)


def document_shingles(words: Words, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles, ascending; a text of fewer words has its whole sequence as one."""
    h = words.hashes()
    s = shingles(h, k)
    for a, b in zip(words.ptr[:-1], words.ptr[1:], strict=True):
        if b - a >= k:
            yield np.unique(s[a : b - k + 1])
        elif b > a:
            yield shingles(h[a:b], int(b - a))
        else:
            yield np.empty(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(parts: list[np.ndarray]) -> pa.ListArray:
    """A list<int64> column from uint64 or int64 arrays."""
    lengths = np.array([len(p) for p in parts], dtype=np.int32)
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
