"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Used inside ``mapInArrow`` functions.  A text is cut at separator bytes, which
are all ASCII, so that bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text is worked on alone.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and ``base ** -i`` modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(size, b, _U)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        have = _powers[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def forget() -> None:
    """Drop what is remembered between calls."""
    _powers.clear()


@dataclass
class Words:
    """Words of the texts of one chunk; ``first[d]:first[d + 1]`` are those of text d."""

    bytes_: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.start), _U)
        n, at = len(self.start), 0
        while at < n:  # by pieces, so that a very long text takes little memory
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + CHUNK_BYTES, "right")))
            lo, hi = int(self.start[at]), int(self.end[to - 1])
            up, down = powers(_BYTE_BASE, hi - lo + 1)
            sums = np.zeros(hi - lo + 1, _U)
            np.cumsum(_BYTE_VALUE[self.bytes_[lo:hi]] * up[:-1], out=sums[1:])
            s, e = self.start[at:to] - lo, self.end[at:to] - lo
            out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)
            at = to
        return mix(out)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by one space."""
        b = self.bytes_
        return b" ".join([b[s:e].tobytes() for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True)])


def find(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> Words:
    """Words of the texts ``data[offsets[d]:offsets[d + 1]]``."""
    data = data[: offsets[-1]]
    inside = ~separator[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = ~inside[:-1]
    start = np.flatnonzero(inside & (before | cut[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = ~inside[1:]
    end = np.flatnonzero(inside & (after | cut[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, whatever texts they stand in; n - k + 1 of them."""
    n = len(hashes)
    if n < k:
        return np.empty(0, _U)
    up, down = powers(_WORD_BASE, n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def chunks(texts: pa.Array, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts of about ``size``; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        piece = data[offsets[at] : offsets[to]]
        yield at, to, LOWER[piece] if lower else piece, offsets[at : to + 1] - offsets[at]
        at = to
