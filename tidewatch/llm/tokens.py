"""Token ids of many texts by a public tokenizer file, with bounded caches.

The vocabulary's pre-tokenizer drops white space and never joins across it, so
a text's ids are those of its parts between white space in order. A batch's
parts are hashed together, and only distinct ones are looked up. Parts that the
cache lacks, if made of printable Latin characters, are split into words, which
are looked up likewise and encoded by the model's direct path; all remaining
parts take the full tokenizer.

A cache tells parts by their 64-bit hash and is arrays of numbers, about 50
bytes a part. It starts anew when it is full, so a worker's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import regex

from . import text

#: Parts, and words, that a worker process keeps.
CACHED_PARTS, CACHED_WORDS = 500_000, 500_000
#: Fixed value: the pre-tokenizer's pattern in the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS = regex.compile(r"\n|" + PATTERN)
#: Characters that normalising leaves alone but for case.
_PLAIN = regex.compile(r"[!-~¡-¬®-įı-ſ]+")


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ..., begin + size - 1 of all pairs in order."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(int(size.sum()))


class _Known:
    """Ids by hash, in sorted arrays."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def lacks(self, kinds: np.ndarray) -> np.ndarray:
        """Which of the sorted hashes are not here; a full cache is emptied first."""
        if len(self.keys) > self.most:
            self.clear()
        place = np.searchsorted(self.keys, kinds)
        out = np.ones(len(kinds), bool)
        inside = place < len(self.keys)
        out[inside] = self.keys[place[inside]] != kinds[inside]
        return out

    def add(self, kinds: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        place, begin = np.searchsorted(self.keys, kinds), len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate((self.ids, ids))
        self.keys, self.at, self.size = (np.insert(old, place, more) for old, more in ((self.keys, kinds), (self.at, begin), (self.size, size)))

    def get(self, kinds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of kinds[which] in order, and how many each has."""
        place = np.searchsorted(self.keys, kinds)[which]
        return self.ids[_spread(self.at[place], self.size[place])], self.size[place]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return size, np.fromiter((i for x in lists for i in x), np.uint32, int(size.sum()))


class PartEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.letters = {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}
        self.parts, self.words = _Known(CACHED_PARTS), _Known(CACHED_WORDS)

    def _plain(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of parts of printable Latin characters, a part a line."""
        found = _WORDS.findall(lines.lower())
        ends = np.fromiter((w == "\n" for w in found), bool, len(found))
        part = np.cumsum(ends)[~ends]
        said = [w for w in found if w != "\n"]
        buf = np.frombuffer(("\n".join(said) + "\n").encode(), np.uint8)
        kinds, first, which = np.unique(text.runs(buf, *text.parts(buf)), return_index=True, return_inverse=True)
        new = self.words.lacks(kinds)
        if new.any():
            spelt = "\n".join([said[i] for i in first[new].tolist()]).encode().decode("latin-1").translate(self.letters).split(self.letters[10])
            tokenize = self.model.tokenize
            self.words.add(kinds[new], *_flat([[t.id for t in tokenize(s)] for s in spelt]))
        ids, size = self.words.get(kinds, which)
        return np.bincount(part, size, int(ends.sum()) + 1).astype(np.int64), ids

    def _encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of parts of ``buf``."""
        size = ends - starts + 1
        lines = buf[_spread(starts, size)]
        lines[np.cumsum(size) - 1] = 10
        odd = lines >= 128
        odd[:-1] |= (lines[:-1] == 60) & (lines[1:] == 124)  # "<|" may begin a special token
        plain = np.add.reduceat(odd, np.cumsum(size) - size) == 0
        parts = lines.tobytes().decode("utf-8", "surrogatepass").split("\n")
        for i in np.flatnonzero(~plain).tolist():
            plain[i] = bool(_PLAIN.fullmatch(parts[i])) and "<|" not in parts[i]
        sizes, ids = np.zeros(len(starts), np.int64), [np.zeros(0, np.uint32)] * 2
        if plain.any():
            sizes[plain], ids[0] = self._plain("\n".join([parts[i] for i in np.flatnonzero(plain).tolist()]))
        if not plain.all():
            sizes[~plain], ids[1] = _flat([self.full.encode(parts[i], add_special_tokens=False).ids for i in np.flatnonzero(~plain).tolist()])
        out, of = np.zeros(int(sizes.sum()), np.uint32), np.repeat(plain, sizes)
        out[of], out[~of] = ids
        return sizes, out

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (one entry more than texts)."""
        buf, at = text.joined(texts, lower=False)
        starts, ends = text.parts(buf)
        kinds, first, which = np.unique(text.runs(buf, starts, ends), return_index=True, return_inverse=True)
        new = self.parts.lacks(kinds)
        if new.any():
            self.parts.add(kinds[new], *self._encode(buf, starts[first[new]], ends[first[new]]))
        out, size = self.parts.get(kinds, which)
        return out, np.concatenate(([0], np.cumsum(size)))[np.searchsorted(starts, at)]


@lru_cache(1)
def encoder(path: str) -> PartEncoder:
    """One for each worker process and file."""
    return PartEncoder(path)
