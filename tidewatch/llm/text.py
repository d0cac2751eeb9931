"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of bytes other than ASCII white space in the
lower-cased UTF-8 text. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Fixed odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: UTF-8 bytes handled at a time (one longer text is handled alone).
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        grown = np.full(max(n, CHUNK_BYTES + 4096), base, np.uint64)
        grown[0] = 1
        have = _powers[base] = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64))


def runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs [start, end), which are in order and apart. A text of any length is hashed in stretches."""
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK_BYTES, side="right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * powers(BASE, hi - lo), out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((sums[e] - sums[s]) * powers(INVERSE, hi - lo + 1)[s] + (e - s).astype(np.uint64))
        a = b
    return out


@dataclass
class Words:
    """``hashes[at[i]:at[i + 1]]`` are the words of the i-th text, and ``buf_at[i + 1] - buf_at[i]`` its bytes."""

    hashes: np.ndarray
    at: np.ndarray
    buf_at: np.ndarray


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


def joined(texts: Sequence[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, a newline after each, and where each begins (one entry more than texts)."""
    parts = [((t.lower() if lower else t).encode("utf-8", "surrogatepass") if t else b"") for t in texts]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1, out=at[1:])
    parts.append(b"")
    return np.frombuffer(b"\n".join(parts), np.uint8), at


def parts(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of bytes other than ASCII white space; the last byte is white space."""
    edge = np.flatnonzero(np.diff(_SPACE[buf], prepend=True))
    return edge[0::2], edge[1::2]


def words(texts: Sequence[str | None]) -> Words:
    buf, at = joined(texts)
    starts, ends = parts(buf)
    return Words(runs(buf, starts, ends), np.searchsorted(starts, at), at)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of all words together if they are fewer; none of no words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += hashes[j : n - k + 1 + j] * np.uint64(pow(BASE, j + 1, 2**64))
    return mix(out)
