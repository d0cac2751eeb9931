"""Secrets in texts: fixed patterns, and strings that no dictionary explains.

Beside the patterns, each run of token characters in a sensitive context (a word
such as token, key or bearer shortly before it) is a candidate. What it costs is
measured: the bytes that zstandard needs for the text around it with the
candidate, less those without. The compressor is primed with the identifiers
that most documents of the whole table use, so a name put together from known
words, a padding or a repetition costs little, while a random string costs more
than its alphabet's entropy. Candidates of at least ``NOVELTY`` times that
entropy are reported. Other occurrences of the candidate are taken out of the
text around it: a secret that is told twice stays one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import frugal

#: Fixed patterns of the base kinds, in the order in which they are told, and the least length of each.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

#: A candidate, and the words that make a context sensitive.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secrets?|tokens?|api[_-]?keys?|keys?|credentials?|auth|authorization|bearer|signature|akia)(?![a-z])", re.IGNORECASE | re.ASCII)
#: Characters between a sensitive word and its candidate, and of the text around it on either side.
REACH, AROUND = 64, 256
#: Marginal bits, in bits of a random string over the same alphabet, from which a candidate is novel. Measured: 98 % of random strings of 16
#: to 64 characters lie above 1.2, names of known words at 0.4 to 0.9 (at 1.1 where the words are of four letters and less).
NOVELTY = 1.2
LEVEL = 3

#: Identifiers in the dictionary at most (the most frequent, by number of documents), and its bytes.
MAX_IDENTIFIERS, MAX_BYTES = 8192, 1 << 16
_IDENTIFIER = re.compile(r"[A-Za-z]{3,32}")
#: Runs that are no secrets whatever a table holds.
_FIXED = "0123456789012345678901234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 9876543210 qwertyuiop asdfghjkl zxcvbnm"

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base kinds, in order; positions count code points, ends are exclusive."""
    found = []
    folded = text.lower()
    if any(w in folded for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    # a hex run that is long enough lies in a run of candidate characters
    for run in CANDIDATE.finditer(text):
        if run.end() - run.start() >= LEAST_HEX:
            found += [(run.start() + m.start(), 2, run.start() + m.end()) for m in HEX.finditer(run[0]) if len(m[0]) >= LEAST_HEX]
    return sorted(found)


class Novelty:
    """Marginal compressed size of strings, given a dictionary of identifiers."""

    def __init__(self, identifiers: list[str]):
        """``identifiers``: the most frequent first."""
        kept, room = [], MAX_BYTES - len(_FIXED) - 1
        for w in identifiers:
            room -= len(w) + 1
            if room < 0:
                break
            kept.append(w)
        # what is nearest to the text is told in the fewest bits
        primed = zstandard.ZstdCompressionDict(" ".join([_FIXED, *reversed(kept)]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(LEVEL)
        self._compressor = zstandard.ZstdCompressor(dict_data=primed, write_checksum=False, write_content_size=False)

    def _size(self, text: str) -> int:
        return len(self._compressor.compress(text.encode("utf-8", "surrogatepass")))

    def of(self, text: str, start: int, end: int) -> float:
        """What text[start:end] adds to the text around it, as a multiple of its alphabet's entropy."""
        own = text[start:end]
        before, after = (s.replace(own, " ") for s in (text[max(0, start - AROUND) : start], text[end : end + AROUND]))
        return 8 * (self._size(before + own + after) - self._size(before + " " + after)) / (entropy(own) * (end - start))


def entropy(own: str) -> float:
    """Bits a character of a random string over the classes of characters that ``own`` has (letters to f only: hex)."""
    lower, upper = max((c for c in own if c.islower()), default=""), max((c for c in own if c.isupper()), default="")
    size = 10 * any(c.isdigit() for c in own) + 2 * any(c in "+/_=-" for c in own)
    size += (0 if not lower else 6 if lower <= "f" else 26) + (0 if not upper else 6 if upper <= "F" else 26)
    return math.log2(size)


def novel_spans(text: str, base: list[Span], novelty: Novelty) -> list[Span]:
    """Spans that the method adds: none overlaps one of ``base``."""
    found, b, told = [], 0, -1
    by_start = sorted((s, e) for s, _, e in base)
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        own = m[0]
        digits = sum(c.isdigit() for c in own)
        if digits < 2 or sum(c.isalpha() for c in own) < 2 or own.startswith("/"):
            continue
        while b < len(by_start) and by_start[b][1] <= start:
            b += 1
        if any(s < end and start < e for s, e in islice(by_start, b, b + 3)):
            continue
        # a run that only white space parts from one just reported is its next line
        if (told < 0 or text[told:start].strip()) and not SENSITIVE.search(text[max(0, start - REACH) : start]):
            continue
        if novelty.of(text, start, end) >= NOVELTY:
            found.append((start, 3, end))
            told = end
    return found


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _without_secrets(run: re.Match) -> str:
    """A run that may be a secret teaches no identifier, however many copies of it there are."""
    return " " if any(c.isdigit() for c in run[0]) else run[0]


def _identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n: Counter[str] = Counter()
        for t in batch.column(0).to_pylist():
            if t:
                n.update(set(_IDENTIFIER.findall(CANDIDATE.sub(_without_secrets, t))))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])


def identifiers(documents: DataFrame) -> list[str]:
    """The identifiers of most documents, the most frequent first and ties by name: ``MAX_IDENTIFIERS`` strings of at most 32 characters."""
    counts = documents.select("text").mapInArrow(frugal(_identifiers), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(MAX_IDENTIFIERS).collect()]


def _scan(known: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_novel", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py() or ""
                base = base_spans(t)
                more = novel_spans(t, base, novelty)
                n = Counter(k for _, k, _ in base)
                rows.append((doc_id, n[0], n[1], n[2], hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(base + more), len(more)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return frugal(scan)


def secrets(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    ``spans`` are all secrets as kind:start:end, in order and comma-joined; kinds
    are assign, access, hex and novel. Positions count code points, ends are
    exclusive. base_sha256 is the lowercase hex digest of the first three kinds'
    spans told likewise (of nothing, where there is none). Whole texts are
    scanned, in time that grows with their length; a null text is empty and a
    null doc_id stays. Repeated rows are scanned one by one. Columns other than
    doc_id and text are not read, whatever their names. An empty table gives an
    empty result. The dictionary of identifiers is counted over all documents
    and has a fixed size.
    """
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(identifiers(documents)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
