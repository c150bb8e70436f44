"""Words, lines and their hashes for a whole Arrow column of texts at once, by numpy over the UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLOCK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit hashes to numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the n + 1 offsets; NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return flat, off - off[0]


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that cross no document boundary: starts, ends (exclusive) and document numbers."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    head = np.zeros(n + 1, bool)
    head[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | head[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | head[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: tuple[int, ...] = ()):
    """A 64-bit hash of each byte span; spans are ordered and do not overlap. Works in blocks of about 2 MB.

    With ``heads``, a list: the hashes of the whole spans, then of their first so many bytes for each length.
    """
    out = [np.empty(len(starts), np.uint64) for _ in range(1 + len(heads))]
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        seg = data[base : ends[hi - 1]]
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(seg), _BASE)]))
        total = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_BYTE[seg] * power[:-1], out=total[1:])
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(seg), _INVERSE)]))[a]
        for k, end in enumerate([b, *[np.minimum(a + n, b) for n in heads]]):
            out[k][lo:hi] = mix((total[end] - total[a]) * back + (end - a).astype(np.uint64))
        lo = hi
    return out if heads else out[0]


def words(texts: pa.Array, lower: bool = True):
    """Words of a text column (runs without ASCII white space): hash and document number of each, in order."""
    data, off = raw(pc.utf8_lower(texts) if lower else texts)
    starts, ends, doc = spans(~SPACE[data], off)
    return hash_spans(data, starts, ends), doc


def slices(texts: pa.Array, most: int = 4 << 20):
    """Cut a column into runs of rows of at most ``most`` bytes of text (a longer text alone): (first row, piece)."""
    if len(texts) == 0:
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    first, done = 0, 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(size, done + most, "right")))
        yield first, texts.slice(first, last - first)
        first, done = last, size[last - 1]
