"""Language identification of very long texts: block by block as in one go, in bounded memory."""

import subprocess
import sys

import numpy as np
import pytest

from tidewatch.llm import langid

LANGS = {"de": "der die das und nicht eine straße über läuft schön", "en": "the and not street over runs with beautiful of", "ru": "и не улица над бежит красивая что они"}


def _model():
    counts = np.zeros((len(LANGS), langid.BUCKETS + len(langid.SCRIPT_NAMES)))
    for i, words in enumerate(LANGS.values()):
        points, starts, ends, _ = langid.split_words([words])
        counts[i, : langid.BUCKETS] = np.bincount(langid.ngrams(points, starts, ends)[0], minlength=langid.BUCKETS)
        counts[i, langid.BUCKETS :] = np.bincount(langid._classes()[1][points[starts]], minlength=len(langid.SCRIPT_NAMES))
    return langid.Model(list(LANGS), counts)


def _text(rng, n):
    out = []
    while len(out) < n:
        own = list(LANGS.values())[rng.integers(3)].split()
        out += [own[i] for i in rng.integers(len(own), size=rng.integers(1, 40))]
    return "".join(w + str(rng.choice([" ", "\n", ", ", "1"], p=[0.9, 0.05, 0.04, 0.01])) for w in out)


@pytest.mark.parametrize("block,longest", [(64, 64), (1000, 8), (4096, 1024)])
def test_blocks_give_the_path_of_the_whole_text(monkeypatch, block, longest):
    monkeypatch.setattr(langid, "LONGEST", longest)
    model, rng = _model(), np.random.default_rng(block)
    for words in (0, 1, 30, 3000):
        value = _text(rng, words) if words else "123 !!"
        monkeypatch.setattr(langid, "BLOCK", 1 << 30)
        whole, one = langid.spans(model, value), langid.shares(model, [value])
        monkeypatch.setattr(langid, "BLOCK", block)
        assert langid.spans(model, value) == whole and (langid.shares(model, [value]) == one).all()
        assert "".join(langid.cuts(value)) == value and all(len(c) <= block for c in langid.cuts(value))


def test_a_word_without_end_and_marks_are_cut(monkeypatch):
    monkeypatch.setattr(langid, "LONGEST", 16)
    monkeypatch.setattr(langid, "BLOCK", 64)
    model = _model()
    assert langid.shares(model, ["и" * 1000])[0].tolist() == [0, 0, 1000]
    assert langid.shares(model, ["́" * 1000]).sum() == 0
    assert langid.spans(model, "the " * 40 + "и" * 200)[-1][1] == 360


def test_scores_of_millions_of_words_keep_their_digits():
    # each word leans to language 1 by less than the digits that a float has left after a million words
    scores = np.tile(np.array([-20.0, -19.99], np.float32), (600_000, 1))
    scores[:1000] = [-19.0, -20.0]
    path = langid.viterbi(scores, np.array([0, len(scores)]), 6.0)
    assert (path[:1000] == 0).all() and (path[1000:] == 1).all()


SCRIPT = """
import resource, sys
sys.path.insert(0, sys.argv[1])
from tests.llm.test_langid_blocks import _model, _text
import numpy as np
from tidewatch.llm import langid
model, piece = _model(), _text(np.random.default_rng(1), 20000)
langid.shares(model, [piece])
value = piece * (50_000_000 // len(piece.encode()) + 1)
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
share = langid.shares(model, [value])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base, int(share.sum()))
"""


def test_fifty_megabytes_take_less_than_a_gigabyte():
    root = __file__.rsplit("/tests/", 1)[0]
    out = subprocess.run([sys.executable, "-c", SCRIPT, root], capture_output=True, text=True, check=True, timeout=600)
    kilobytes, letters = map(int, out.stdout.split())
    assert kilobytes < 600_000 and letters > 30_000_000
