"""Vectorised tokenising and hashing of Arrow text columns inside a task.

Texts are handled as UTF-8 bytes.  A word is a maximal run of bytes outside
``[\\x20\\x09-\\x0D]``; these are ASCII, so no multi-byte character is split.
Words, lines and windows are compared by 64-bit hashes.  Work proceeds in
chunks of about ``CHUNK_BYTES`` of whole texts, so memory does not depend on
the batch size; only a single longer text makes a larger chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_ODD), -1, 1 << 64))

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        up, down = np.full(size, _ODD), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per byte span; spans are ordered and do not overlap.

    Prefix sums of byte times base**position, multiplied by the inverse power
    of the start, give a hash that does not depend on where the span lies.
    """
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK_BYTES, "right")))
        hi = int(ends[j - 1])
        up, down = _power_tables(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


@dataclass
class Chunk:
    """Whole texts of consecutive rows: bytes, and where each row's bytes begin."""

    first: int            # row number in the batch
    data: np.ndarray      # bytes of all texts, one after the other
    offsets: np.ndarray   # rows + 1 byte offsets into data

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each row are set in ``mask``."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of runs of ``inside`` within rows, and each row's offset into them."""
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self.offsets), np.int64)
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[self.offsets] = True
        before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = np.flatnonzero(inside & (edge[:-1] | ~before))
        ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~SPACE[self.data])


def chunks(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[Chunk]:
    """Cut a text column into chunks of whole rows; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, where, raw = texts.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1))
        data = raw[offsets[i]:offsets[j]]
        yield Chunk(i, LOWER[data] if lower else data, offsets[i:j + 1] - offsets[i])
        i = j


_WEIGHTS = mix(np.arange(1, 65, dtype=U64) * _ODD) | U64(1)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` consecutive word hashes (order matters)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = words[:n] * _WEIGHTS[0]
    for k in range(1, width):
        total = total + words[k:k + n] * _WEIGHTS[k]
    return mix(total)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct window hashes; a shorter text is one window, no words no set."""
    if not len(words):
        return np.zeros(0, U64)
    return np.unique(window_hashes(words, min(width, len(words))))


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as the signed integers that Spark stores."""
    return np.ascontiguousarray(h).view(np.int64)
