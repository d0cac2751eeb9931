"""The quality query against a plain restatement: windows, counts, ratios, cut and draw, one token and one document at a time."""

import math
import random
import re
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import quality, text


@cache
def one_hash(token: bytes) -> int:
    return int(text.runs(np.frombuffer(token + b" ", np.uint8), np.array([0]), np.array([len(token)]))[0])


@cache
def one_pair(x: int, y: int) -> int:
    return int(text.mix(np.array([x], np.uint64) * np.uint64(3) + np.array([y], np.uint64))[0])


def windows(value: str | None) -> list[set]:
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+", (value or "").encode())
    out = []
    for a in range(0, len(tokens), quality.WINDOW):
        part = [one_hash(t) for t in tokens[a : a + quality.WINDOW]]
        found, repeats = {h % quality.BUCKETS for h in part}, 0
        for x, y in zip(part, part[1:]):
            if x != y:
                found.add(quality.BUCKETS + one_pair(x, y) % quality.PAIRS)
            else:
                repeats += 1
                if repeats & (repeats - 1) == 0:
                    found.add(quality.BUCKETS + quality.PAIRS + repeats.bit_length() - 1)
        out.append(found)
    return out


def gamma_poisson(shape: float, n: int, expected: float) -> float:
    return math.lgamma(shape + n) - math.lgamma(shape) + shape * math.log(shape / (shape + expected)) - n * math.log(shape + expected)


def test_the_query_equals_its_restatement(spark):
    r = random.Random(8)
    vocabulary = [f"word{i}é" if i % 9 == 0 else f"word{i}" for i in range(250)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = {i: " ".join(some(r.randrange(30, 700))) for i in range(160)}
    texts |= {1000 + i: ", ".join(some(50)) + " spam spam spam spam" * r.randrange(1, 4) for i in range(70)}
    texts |= {2000: None, 2001: "", 2002: "  ", 2003: texts[0]}
    label = {i: (1, 0) for i in range(0, 160, 2)} | {1000 + i: (0, 0) for i in range(0, 70, 2)} | {2003: (1, 0)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lab = spark.createDataFrame([(i, *q) for i, q in label.items()] + [(7, None, 1)], "doc_id long, quality int, toxic int")

    held = {x["doc_id"] for x in lab.where(F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(quality.HELD_OUT)) == 0).collect()}
    target, raw, n_target, n_raw = Counter(), Counter(), 0, 0
    for i, q in label.items():
        if i not in held:
            for w in windows(texts[i]):
                raw.update(w)
                n_raw += 1
                if q == (1, 0):
                    target.update(w)
                    n_target += 1
    ratio = {}
    for f, n in raw.items():
        expected = n * n_target / n_raw
        odds = math.log(quality.OTHER_SHARE / (1 - quality.OTHER_SHARE)) + gamma_poisson(quality.OTHER, target[f], expected) - gamma_poisson(quality.SAME, target[f], expected)
        p = 1 / (1 + math.exp(-odds))
        ratio[f] = math.log(1 - p + p * (target[f] + quality.OTHER) / (expected + quality.OTHER))
    weight = {i: min((sum(ratio.get(f, 0.0) for f in w) for w in windows(t)), default=0.0) for i, t in texts.items()}

    told = sorted((weight[i], label[i] == (1, 0)) for i in label if i in held)
    errors = lambda cut: sum(y == (w < cut) for w, y in told)
    fewest = min(errors(w + e) for w, _ in told for e in (-1e-9, 1e-9))
    out = {x["doc_id"]: x for x in quality.sampled(d, lab, 0.4).collect()}
    gone = [w for i, w in weight.items() if i not in out]
    assert gone and max(gone) < min(weight[i] for i in out)  # all below one cut, which is no worse than any other
    assert errors((max(gone) + min(weight[i] for i in out)) / 2) == fewest or min(weight[i] for i in out) >= 0
    assert set(out) >= {2000, 2001, 2002} and all(abs(out[i]["log_weight"] - weight[i]) < 1e-3 for i in out)

    noise = {x["doc_id"]: x["g"] for x in d.select("doc_id", quality.gumbel(29, "doc_id").alias("g")).collect()}
    keys = {i: out[i]["log_weight"] + noise[i] for i in out}
    first = sorted(keys, key=keys.get, reverse=True)[: int(0.4 * len(out))]
    assert {i for i in out if out[i]["drawn"]} == set(first)
    assert not any(x["drawn"] for x in quality.sampled(d, lab, 0.001).collect())
    assert quality.sampled(d.limit(0), lab, 0.5).isEmpty()
