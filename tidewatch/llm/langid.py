"""Language of every word of a text, by script ranges and a Viterbi path.

A word's script narrows the candidate languages to those seen in that script;
each candidate scores the word by hashed character n-gram log-probabilities;
the best path over a text's words, where a change of language costs a penalty,
labels its spans. A document's language is the one that most of its letters
are labelled with.

Paths are found exactly and for many texts at once: words are cut into segments,
each segment's best scores between all entry and exit languages are found for
all segments together, and those are chained text by text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

# First and last code point of the ranges told apart (Unicode blocks). Others are script 0.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x3040, 0x30FF, "Kana"),
    (0x4E00, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
]
SCRIPT_NAMES = ["", *dict.fromkeys(name for _, _, name in SCRIPTS)]

BUCKETS = 1 << 15
MAX_TRAINING = 8_000
PENALTY = 6.0
SEGMENT = 64
#: Characters that are labelled at once, and of the longest word; the first is a multiple of the second.
BLOCK, LONGEST = 1 << 20, 1 << 14
#: A language writes in a script if so large a share of its training words does.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"

_tables: list[np.ndarray] = []


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By code point: letter (2), mark (1) or neither (0); and script."""
    if not _tables:
        import unicodedata

        kind = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            kind[c] = 2 if k == "L" else k == "M"
        script = np.zeros(0x110000, np.uint8)
        for a, b, name in SCRIPTS:
            script[a : b + 1] = SCRIPT_NAMES.index(name)
        _tables.extend((kind, script))
    return _tables[0], _tables[1]


def split_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, and of each word its start, end and text. Words are runs of letters and marks that hold a letter; every LONGEST characters of a longer one count as one."""
    kind, _ = _classes()
    points = np.frombuffer("\n".join([(t or "").lower() for t in texts] + [""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate(([0], np.flatnonzero(points == 10) + 1))
    k = kind[points]
    edge = np.diff((k > 0).astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    many = -(-(ends - starts) // LONGEST)
    if (many > 1).any():
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        starts, ends = np.repeat(starts, many) + nth * LONGEST, np.repeat(ends, many)
        ends = np.minimum(ends, starts + LONGEST)
    letters = np.concatenate(([0], np.cumsum(k == 2)))
    real = letters[ends] > letters[starts]
    starts, ends = starts[real], ends[real]
    # texts hold newlines of their own: lines to texts
    lines = np.array([(t or "").count("\n") + 1 for t in texts])
    firsts = at[np.concatenate(([0], np.cumsum(lines)))[:-1]] if len(texts) else at[:0]
    return points, starts, ends, np.searchsorted(firsts, starts, side="right") - 1


def ngrams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams of each word with its borders, and of the word itself; and the word each is of."""
    n = ends - starts
    at = np.concatenate(([0], np.cumsum(n + 2)))
    padded = np.full(at[-1], 7, np.uint64)
    word = np.repeat(np.arange(len(n)), n)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    padded[at[word] + 1 + inner] = points[starts[word] + inner]
    owner = np.repeat(np.arange(len(n)), n + 2)
    out, of = [], []
    whole = np.zeros(len(padded) + 1, np.uint64)
    np.cumsum(text.salted(padded, 9) * (np.arange(len(padded), dtype=np.uint64) - at[owner].astype(np.uint64) + np.uint64(1)), out=whole[1:])
    grams = padded
    for order in (1, 2, 3):
        if order > 1:
            grams = text.mix(grams[:-1] * np.uint64(0x2545F4914F6CDD1D) + padded[order - 1 :])
        same = owner[order - 1 :] == owner[: len(owner) - order + 1]
        out.append(text.salted(grams, order)[same] % np.uint64(BUCKETS))
        of.append(owner[: len(owner) - order + 1][same])
    out.append(text.salted(whole[at[1:]] - whole[at[:-1]], 4) % np.uint64(BUCKETS))
    of.append(np.arange(len(n)))
    return np.concatenate(out).astype(np.int64), np.concatenate(of)


def _word_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * text.powers(text.BASE, len(points)), dtype=np.uint64)))
    return text.mix((sums[ends] - sums[starts]) * text.powers(text.INVERSE, len(points) + 1)[starts] + (ends - starts).astype(np.uint64))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by (language, feature); features from BUCKETS on are scripts."""
    counts: dict[str, np.ndarray] = {}
    _, script = _classes()
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for lang in set(langs):
            own = counts.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
            texts = [t for t, x in zip(batch.column(0).to_pylist(), langs, strict=True) if x == lang]
            for a, b in text.chunks(texts):
                points, starts, ends, _ = split_words(texts[a:b])
                own[:BUCKETS] += np.bincount(ngrams(points, starts, ends)[0], minlength=BUCKETS)
                own[BUCKETS:] += np.bincount(script[points[starts]], minlength=len(SCRIPT_NAMES))
    for lang, own in counts.items():
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(own[some])], ["lang", "feature", "n"])


class Model:
    """Languages, log-probabilities (feature, language) and which languages a script may hold."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams, scripts = counts[:, :BUCKETS].astype(np.float64), counts[:, BUCKETS:].astype(np.float64)
        every = (grams.sum(axis=0) + 0.5) / (grams.sum() + 0.5 * BUCKETS)
        self.logs = np.log((grams + 200.0 * every) / (grams.sum(axis=1, keepdims=True) + 200.0)).T.astype(np.float32).copy()
        used = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.allowed = used.T | ~used.any(axis=0)[:, None]


def train(documents: DataFrame, rows: Column, max_training: int = MAX_TRAINING) -> Model | None:
    """Fitted on at most ``max_training`` documents of those ``rows`` selects: the ids that hash lowest."""
    known = documents.where(rows & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training)
    got = known.join(F.broadcast(ids), "doc_id").select("text", "lang").mapInArrow(_tally, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if not langs:
        return None
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)))
    place = {x: i for i, x in enumerate(langs)}
    counts[[place[x] for x in got.column("lang").to_pylist()], got.column("feature").to_numpy()] = got.column("n").to_numpy()
    return Model(langs, counts)


class _Paths:
    """Best paths over the words of many texts, segment by segment; ``before`` are the scores of each language ahead of a text's first word."""

    def __init__(self, scores: np.ndarray, at: np.ndarray, penalty: float, before: np.ndarray | None = None):
        n, size = scores.shape
        lengths = np.diff(at)
        pieces = -(-lengths // SEGMENT)
        self.first = first = np.concatenate(([0], np.cumsum(pieces)))
        text_of = np.repeat(np.arange(len(lengths)), lengths)
        inner = np.arange(n) - at[text_of]
        self.seg, self.step = first[text_of] + inner // SEGMENT, inner % SEGMENT
        self.padded = np.zeros((SEGMENT, int(first[-1]), size), scores.dtype)
        self.padded[self.step, self.seg] = scores
        self.penalty = penalty
        # best score from each entry language (axis 1) to each exit language (axis 2)
        through = np.where(np.eye(size, dtype=bool), 0, -np.inf).astype(scores.dtype)[None].repeat(first[-1], axis=0)
        for t in range(SEGMENT):
            through = np.maximum(through, through.max(axis=2, keepdims=True) - penalty) + self.padded[t][:, None, :]
        # chain the segments of each text; longest texts first, so that those that go on are a prefix
        self.order = np.argsort(-pieces, kind="stable")
        self.going = pieces[self.order]
        best = np.zeros((len(self.order), size), scores.dtype) if before is None else before[self.order]
        self.came = np.zeros((int(first[-1]), size), np.int16)
        for j in range(int(self.going[0])):
            segs = self._running(j)
            sums = best[: len(segs), :, None] + through[segs]
            self.came[segs] = sums.argmax(axis=1)
            best[: len(segs)] = sums.max(axis=1)
            # only differences count: sums of long texts would outgrow the digits of a float
            best[: len(segs)] -= best[: len(segs)].max(axis=1, keepdims=True)
        self.best = best

    def _running(self, j: int) -> np.ndarray:
        m = int(np.searchsorted(-self.going, -j, side="left"))
        return self.first[self.order[:m]] + j

    def after(self) -> np.ndarray:
        """Scores of each language after a text's last word, less the best of them."""
        out = np.empty_like(self.best)
        out[self.order] = self.best
        return out

    def trace(self, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Language of each word on the best path that ends in ``last`` (None: the best), and each text's language ahead of its first word."""
        _, many, size = self.padded.shape
        exits, entries = np.zeros(many, np.int64), np.zeros(many, np.int64)
        now = self.best.argmax(axis=1) if last is None else last[self.order].copy()
        for j in range(int(self.going[0]) - 1, -1, -1):
            segs = self._running(j)
            m = len(segs)
            exits[segs] = now[:m]
            now[:m] = self.came[segs, now[:m]]
            entries[segs] = now[:m]
        # within segments, from the entry found to the exit found
        value = np.where(np.arange(size) == entries[:, None], 0, -np.inf).astype(self.padded.dtype)
        back = np.zeros((SEGMENT, many, size), np.int16)
        own = np.arange(size, dtype=np.int16)
        for t in range(SEGMENT):
            top = value.argmax(axis=1)
            change = np.take_along_axis(value, top[:, None], 1) - self.penalty
            back[t] = np.where(value >= change, own, top[:, None])
            value = np.maximum(value, change) + self.padded[t]
        labels = np.zeros((SEGMENT, many), np.int64)
        state, every = exits, np.arange(many)
        for t in range(SEGMENT - 1, -1, -1):
            labels[t] = state
            state = back[t][every, state].astype(np.int64)
        ahead = np.empty_like(now)
        ahead[self.order] = now
        return labels[self.step, self.seg], ahead


def viterbi(scores: np.ndarray, at: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word; words ``at[i]:at[i + 1]`` are those of text i. Ties go to the smaller number."""
    return _Paths(scores, at, penalty).trace()[0] if len(scores) else np.zeros(0, np.int64)


def word_scores(model: Model, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Score of each word in each language."""
    _, script = _classes()
    _, one, which = np.unique(_word_keys(points, starts, ends), return_index=True, return_inverse=True)
    buckets, word = ngrams(points, starts[one], ends[one])
    # features of one word are not in one run: sum them language by language
    unique = np.stack([np.bincount(word, model.logs[buckets, i], len(one)) for i in range(len(model.langs))], axis=1).astype(np.float32)
    unique[~model.allowed[script[points[starts[one]]]]] = -1e6
    return unique[which]


def cuts(value: str) -> Iterator[str]:
    """A text in blocks of at most BLOCK characters, which end with white space, else between words, else (a word longer than a block) anywhere."""
    kind, _ = _classes()
    at = 0
    while at < len(value):
        block = value[at : at + BLOCK]
        if at + BLOCK < len(value):
            end = max(map(block.rfind, " \n\t")) + 1
            if not end:
                border = np.flatnonzero(kind[np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32)] == 0)
                end = int(border[-1]) + 1 if len(border) else BLOCK
            block = block[:end]
        yield block
        at += len(block)


def label_blocks(model: Model, value: str, penalty: float = PENALTY) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Starts, ends and languages of the words of a text's blocks and the blocks' code points, from the last block to the first.

    The path is that of the whole text: scores run on from block to block, and
    the blocks are then gone through backwards, from the language that each
    must end in. What is kept of a block is one score a language.
    """
    ahead = [np.zeros((1, len(model.langs)), np.float32)]
    for block in cuts(value):
        points, starts, ends, _ = split_words([block])
        ahead.append(_Paths(word_scores(model, points, starts, ends), np.array([0, len(starts)]), penalty, ahead[-1]).after() if len(starts) else ahead[-1])
    last = ahead.pop().argmax(axis=1)
    places = np.concatenate(([0], np.cumsum([len(b) for b in cuts(value)])))
    for i in range(len(ahead) - 1, -1, -1):
        points, starts, ends, _ = split_words([value[places[i] : places[i + 1]]])
        labels = np.zeros(0, np.int64)
        if len(starts):
            labels, last = _Paths(word_scores(model, points, starts, ends), np.array([0, len(starts)]), penalty, ahead[i]).trace(last)
        yield starts, ends, labels, len(points) - 1  # without the newline that ends it


def label_words(model: Model, texts: list[str | None], penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, letters and text number of each word."""
    points, starts, ends, of = split_words(texts)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), of
    at = np.searchsorted(of, np.arange(len(texts) + 1))
    return viterbi(word_scores(model, points, starts, ends), at, penalty), ends - starts, of


def shares(model: Model, texts: list[str | None], penalty: float = PENALTY) -> np.ndarray:
    """Letters of each text (row) that are labelled with each language; a text longer than a block is labelled block by block."""
    size = len(model.langs)
    if len(texts) == 1 and texts[0] and len(texts[0]) > BLOCK:
        return sum((np.bincount(labels, ends - starts, size) for starts, ends, labels, _ in label_blocks(model, texts[0], penalty)), np.zeros(size))[None]
    labels, letters, of = label_words(model, texts, penalty)
    return np.bincount(of * size + labels, letters, len(texts) * size).reshape(-1, size)


def _predict(shared, penalty: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for a, b in text.chunks(texts) if model else ():
                share = shares(model, texts[a:b], penalty)
                for i in np.flatnonzero(share.any(axis=1)):
                    lang[a + i] = model.langs[share[i].argmax()]
                    score[a + i] = share[i].max() / share[i].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names[1:], "lang_pred", "score"])

    return predict


def held_out() -> Column:
    """Documents that are not learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def predict(documents: DataFrame, *, penalty: float = PENALTY, max_training: int = MAX_TRAINING) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score (share of its letters in spans of that language).

    ``und`` with score 0 for null texts, texts without letters, and where
    nothing could be learned. Repeated rows are predicted each; equal shares go
    to the language that sorts first. A text of any length has one path over all
    its words, found block by block: beside the text itself a task holds a block
    (BLOCK characters) and a score for each block and language. An empty table
    gives no rows; columns beyond doc_id, text and lang are not read, whatever their names.
    """
    spark = documents.sparkSession
    model = train(documents, ~held_out(), max_training)
    rows = documents.select("text", "doc_id", held_out().alias("held_out"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model), penalty), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def spans(model: Model, value: str, penalty: float = PENALTY) -> list[tuple[int, int, str]]:
    """(start, end, language) of the spans of one text, in code points of its lower-cased form."""
    blocks = list(label_blocks(model, value, penalty))[::-1]
    ahead = np.concatenate(([0], np.cumsum([size for *_, size in blocks])))
    starts, ends = (np.concatenate([x[i] + at for x, at in zip(blocks, ahead, strict=False)] or [ahead[:0]]) for i in (0, 1))
    labels = np.concatenate([x[2] for x in blocks] or [ahead[:0]])
    out: list[tuple[int, int, str]] = []
    for s, e, x in zip(starts.tolist(), ends.tolist(), labels.tolist(), strict=True):
        if out and out[-1][2] == model.langs[x]:
            out[-1] = (out[-1][0], e, model.langs[x])
        else:
            out.append((s, e, model.langs[x]))
    return out
