"""Operators on texts against plain restatements, and their edge cases."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import chaining, chat, decontam, langid, linededup, minhash, packing, quality, select, sharding, text
from tidewatch.llm.queries import word_tokenizer
from tidewatch.llm.topk import top_k

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], DOC)
    return df.withColumn("node", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("_xx", F.lit(2)) if extra else df


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}x{seed % 7}" for _ in range(n)]


# --- words -------------------------------------------------------------------------
def test_words_are_runs_of_other_than_ascii_space():
    w = text.words(["Ab  ab\tC", None, "", "c", " ab"])
    assert np.diff(w.at).tolist() == [3, 0, 0, 1, 1]
    h = w.hashes
    assert h[0] == h[1] == h[4] and h[2] == h[3] != h[0]


def test_chunks_cover_all_texts():
    ts = ["x" * n for n in (5, 50, 1, 0, 200, 3)] + [None]
    parts = list(text.chunks(ts, 60))
    assert parts[0][0] == 0 and parts[-1][1] == len(ts) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


# --- op1 -----------------------------------------------------------------------------
def plain_jaccard(a, b):
    def sh(t):
        w = t.lower().split()
        k = min(5, len(w))
        out = {}
        for i in range(len(w) - k + 1):
            s = tuple(w[i : i + k])
            out[s] = out.get(s, 0) + 1
        return out

    x, y = sh(a), sh(b)
    both = set(x) & set(y)
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in both)


def test_exact_similarity_equals_its_definition():
    r = random.Random(1)
    for _ in range(30):
        a = [r.choice("abcde") for _ in range(r.randrange(1, 30))]
        b = a[: r.randrange(len(a) + 1)] + [r.choice("abcde") for _ in range(r.randrange(1, 6))]
        sets = [np.unique(text.shingles(text.words([" ".join(t)]).hashes, 5), return_counts=True) for t in (a, b)]
        assert minhash.prob_jaccard(*sets[0], *sets[1]) == pytest.approx(plain_jaccard(" ".join(a), " ".join(b)))


def test_signatures_estimate_the_similarity():
    a, b = words(600, 1), words(600, 1)
    b[200:260] = words(60, 2)
    w = text.words([" ".join(a), " ".join(b)])
    k, n, of = minhash.weighted_shingles(w.hashes, w.at)
    s = minhash.prob_min_hash(k, n, of, 2, 2048)
    assert np.mean(s[0] == s[1]) == pytest.approx(plain_jaccard(" ".join(a), " ".join(b)), abs=0.04)


def near_rows():
    base = words(120, 3)
    rows = [(i, " ".join(base[: 20 + j] + words(4, 50 + i) + base[20 + j :])) for i, j in enumerate(range(0, 60, 3))]
    rows += [(100 + i, " ".join(words(80, 100 + i))) for i in range(15)]
    rows += [(200, rows[3][1]), (201, rows[3][1].upper()), (202, rows[30][1]), (300, "one two"), (301, "One  two"), (302, "one"), (303, ""), (304, None), (305, None), (306, " \n")]
    # a chain: neighbours are alike, the ends are not
    chain = words(200, 9)
    for i in range(6):
        rows.append((400 + i, " ".join(chain[i * 12 : i * 12 + 120])))
    return rows


def plain_classes(rows):
    ids = [i for i, t in rows if t and t.split()]
    texts = dict(rows)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if texts[a].lower().split() == texts[b].lower().split() or plain_jaccard(texts[a], texts[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, rows, extra=True)).collect()}
    want = plain_classes(rows)
    assert len(got) == len(rows)
    assert {i: got[i]["class_id"] for i in want} == want
    for i in (303, 304, 305, 306):
        assert got[i]["class_id"] == i and got[i]["kept"] and got[i]["class_size"] == 1
    assert all(r["kept"] == (r["class_id"] == i) for i, r in got.items())
    left = minhash.without_near_duplicates(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in left) == sorted(set(want.values()) | {303, 304, 305, 306})


def test_near_duplicates_with_null_ids_repeats_and_nothing(spark):
    t = " ".join(words(40, 5))
    rows = [(None, t), (None, t), (7, t), (7, t), (None, "x y z")]
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    assert [r["class_id"] for r in got].count(7) == 4 and sum(r["kept"] for r in got if r["class_id"] == 7) == 2
    assert sorted((r["doc_id"] is None, r["text"][:1]) for r in minhash.without_near_duplicates(docs(spark, rows)).collect()) == [(False, t[0]), (True, "x")]
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


# --- op2 -----------------------------------------------------------------------------
def test_escapes_are_reversible(spark):
    odd = ["", "\\", "\\l", "\\b<", "</turn>\n", "<turn:user>\n", "\\\\l<", "a\\nb\n", ">", chat.PROBE_TEXT]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    for r in df.select("x", chat.unescape(chat.escape(F.col("x"))).alias("y"), chat.unescape_role(chat.escape_role(F.col("x"))).alias("z"), chat.escape(F.col("x")).alias("e")).collect():
        assert r["x"] == r["y"] == r["z"] and "<" not in r["e"]


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"),
        (1, 2, 1, "delta", "assistant", "wr"),
        (1, 3, 1, "delta", "assistant", "ong"),
        (1, 4, 2, "message", "user", "what?"),
        (1, 5, 1, "regenerate", None, None),
        (1, 6, 1, "delta", "assistant", "ri"),
        (1, 7, 1, "delta", "assistant", "ght"),
        (1, 8, 0, "edit", "user", "hello"),
        (2, 1, 0, "message", "user", None),
        (2, 2, 1, "message", "assistant", "x"),
        (2, 3, 1, "delete", None, None),
        (None, 1, 0, "message", None, "n"),
    ]
    got = chat.fold_events(spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")).collect()
    assert {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in got} == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "right"), (2, 0): ("user", ""), (None, 0): ("", "n")}


def test_loss_mask_covers_assistant_texts_only(spark):
    rows = [(1, 0, "user", "a<b"), (1, 1, "assistant", "c</turn>\n\\"), (1, 2, "assistant", ""), (1, 3, "assistant", "é😀")]
    out = chat.chat_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = out.where("conv_id = 1").first()
    import hashlib

    assert (r["n_turns"], r["loss_chars"]) == (4, len("c</turn>\n\\é😀"))
    assert r["loss_sha256"] == hashlib.sha256("c</turn>\n\\é😀".encode()).hexdigest()
    assert out.count() == 2
    assert chat.chat_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1


# --- op3 -----------------------------------------------------------------------------
def test_fuzzy_passages_are_found_and_others_not(spark):
    passage = [f"p{i}" for i in range(70)]
    fuzzy = list(passage)
    for i in range(7, 70, 9):
        fuzzy[i] = f"q{i}"
    shorter = passage[:30]
    rows = [(1, words(100, 1) + passage + words(50, 2)), (2, words(80, 3) + fuzzy + words(60, 4)), (3, words(20, 5) + shorter + words(20, 6)), (4, words(200, 8, 10**6)), (5, passage), (6, []), (7, None)]
    df = docs(spark, [(i, None if t is None else " ".join(t)) for i, t in rows], extra=True)
    got = {(r["doc_id"], r["source_id"]): r for r in chaining.passages(df).collect()}
    assert set(got) == {(2, 1), (5, 1)}
    r = got[(2, 1)]
    assert abs(r["start_word"] - 80) <= 8 and abs(r["end_word"] - 150) <= 8 and r["matched"] >= 55
    assert got[(5, 1)]["matched"] == 70 and (got[(5, 1)]["start_word"], got[(5, 1)]["end_word"]) == (0, 70)
    assert chaining.passages(docs(spark, [])).count() == 0


def test_chaining_equals_brute_force():
    r = random.Random(4)
    for _ in range(40):
        anchors = [(r.randrange(60), r.randrange(60), r.randrange(1, 6)) for _ in range(r.randrange(1, 12))]
        best = 0.0
        for n in range(1, min(5, len(anchors)) + 1):
            for combo in itertools.permutations(sorted(set(anchors)), n) if n <= 3 else ():
                s, ok = combo[0][2], True
                for (x, y, k), (x2, y2, k2) in zip(combo, combo[1:]):
                    gx, gy = x2 - x - k, y2 - y - k
                    ok &= gx >= 0 and gy >= 0
                    s += k2 - chaining.GAP_COST * (gx + gy)
                if ok:
                    best = max(best, s)
        def score(c):
            return c[0][2] + sum(b[2] - chaining.GAP_COST * (b[0] - a[0] - a[2] + b[1] - a[1] - a[2]) for a, b in zip(c, c[1:]))

        found = chaining.chains(sorted(set(anchors)), max_gap=10**9)
        assert score(found[0]) >= best - 1e-9
        assert sorted(a for c in found for a in c) == sorted(set(anchors))


def test_chains_within_the_gap_equal_brute_force():
    r = random.Random(9)
    for _ in range(200):
        gap = r.randrange(3, 40)
        anchors = sorted({(r.randrange(120), r.randrange(120), r.randrange(1, 8)) for _ in range(r.randrange(1, 25))})
        best = []
        for i, (x, y, n) in enumerate(anchors):
            steps = [(x - a - m, y - b - m, best[j]) for j, (a, b, m) in enumerate(anchors[:i])]
            best.append(n + max([0.0, *(s - chaining.GAP_COST * (p + q) for p, q, s in steps if 0 <= p <= gap and 0 <= q <= gap)]))
        found = chaining.chains(anchors, max_gap=gap)
        assert sorted(a for c in found for a in c) == anchors
        assert all(0 <= b[i] - a[i] - a[2] <= gap for c in found for a, b in zip(c, c[1:]) for i in (0, 1))
        first = found[0]
        assert abs(first[0][2] + sum(b[2] - chaining.GAP_COST * (b[0] - a[0] - a[2] + b[1] - a[1] - a[2]) for a, b in zip(first, first[1:])) - max(best)) < 1e-9


def test_a_second_passage_beyond_the_gap_is_found(spark):
    one, two = words(100, 31, 10**6), words(60, 32, 10**6)
    rows = [(1, words(30, 33, 10**6) + one + words(100, 34, 10**6) + two), (2, one + words(100, 35, 10**6) + two + words(30, 36, 10**6))]
    got = chaining.passages(docs(spark, [(i, " ".join(t)) for i, t in rows])).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["source_start"], r["matched"]) for r in got) == [(2, 0, 100, 30, 100), (2, 200, 260, 230, 60)]


def test_a_passage_that_earlier_documents_hold_in_parts_is_found(spark):
    p = words(60, 41, 10**6)
    rows = [(1, words(30, 42, 10**6) + p[:40] + words(30, 43, 10**6)), (2, words(30, 44, 10**6) + p[20:] + words(30, 45, 10**6)), (3, words(30, 46, 10**6) + p + words(9, 47, 10**6)), (4, p + words(30, 48, 10**6))]
    got = chaining.passages(docs(spark, [(i, " ".join(t)) for i, t in rows])).collect()
    assert [tuple(r) for r in got] == [(4, 0, 60, 3, 30, 90, 60)]


def test_a_passage_at_a_later_place_of_the_leader_is_found(spark):
    p = words(60, 51, 10**6)
    parts = [w for i in (0, 13, 26) for w in p[i : i + 34] + words(86, 52 + i, 10**6)]
    rows = [(1, parts + p + words(20, 56, 10**6)), (2, words(25, 57, 10**6) + p)]
    got = chaining.passages(docs(spark, [(i, " ".join(t)) for i, t in rows])).collect()
    assert [tuple(r) for r in got] == [(2, 25, 85, 1, 360, 420, 60)]


def test_edit_matches_of_gaps():
    a = np.array([1, 2, 3, 4, 5], np.uint64)
    assert chaining._edit_matches(a, np.array([1, 9, 3, 5], np.uint64)) == 3
    assert chaining._edit_matches(a, a) == 5 and chaining._edit_matches(a, a[:0]) == 0
    # the extension runs over one difference, and ends where six more differ than agree
    assert chaining._extend(np.array([1, 2, 9, 4, 5, 8, 8, 8, 8, 8, 8, 8]), np.array([1, 2, 3, 4, 5, 7, 7, 7, 7, 7, 7, 7])) == (5, 4)


# --- op4 -----------------------------------------------------------------------------
def test_packing_places_every_token_once(spark):
    from tokenizers import Tokenizer

    r = random.Random(3)
    rows = [(i, " ".join(words(r.randrange(0, 900), i))) for i in range(60)] + [(100, None), (101, ""), (102, "It's <|endoftext|> 12"), (103, " ".join(words(6000, 5)))]
    out = packing.pack(docs(spark, rows, extra=True), word_tokenizer()).collect()
    t = Tokenizer.from_file(word_tokenizer())
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in rows}
    seen = {}
    for p in sorted(out, key=lambda p: (p["doc_id"], p["start"])):
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own) and p["start"] == seen.get(p["doc_id"], 0)
        assert p["ids_crc32"] == zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
        seen[p["doc_id"]] = p["start"] + p["length"]
    assert seen == {i: len(x) for i, x in ids.items()}
    windows = {}
    for p in out:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padding = 0
    for parts in windows.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 4096 * 2
    assert packing.pack(docs(spark, []), word_tokenizer()).count() == 0
    df = docs(spark, rows[:10])
    win = packing.token_windows(df, packing.pack(df, word_tokenizer()), word_tokenizer())
    assert win.select(F.sum(F.size("ids"))).first()[0] == sum(len(ids[i]) for i, _ in rows[:10])


def test_layout_packs_each_tier_and_fills_from_shorter_ones():
    r = random.Random(5)
    counts = {n: r.randrange(1, 5000) for n in [*range(1, 128), *range(128, 4096, 128)]}
    used, padded, total = {}, 0, sum(n * c for n, c in counts.items())
    for tier, pattern, times in packing.layout(counts):
        size = sum(n * m for n, m in pattern)
        assert size <= tier
        padded += times * (4096 - size if size != tier else 0)
        for n, m in pattern:
            used[n] = used.get(n, 0) + m * times
        if size == tier and tier > 512:  # opened by a piece of its own tier
            assert pattern[0][0] > tier // 2
    assert used == counts and padded <= 0.006 * total
    # the longest gap is filled by the longest piece that fits
    assert packing.layout({2200: 1, 1800: 1, 96: 1, 500: 3, 12: 1})[0] == (4096, [(2200, 1), (1800, 1), (96, 1)], 1)
    # without shorter pieces windows stay open, and several tiers share one
    assert packing.layout({1500: 3, 600: 1}) == [(4096, [(1500, 2), (600, 1)], 1), (4096, [(1500, 1)], 1)]


def test_step_groups_hold_their_share_of_every_tier(spark):
    r = random.Random(12)
    rows = [(i, " ".join(words(r.choice([20, 90, 200, 400, 900, 1800]), i))) for i in range(250)]
    out = packing.pack(docs(spark, rows), word_tokenizer(), step_tokens=8 * 4096).select("sequence_id", "tier", "step_group", "length").collect()
    windows, size = {}, {}
    for x in out:
        windows[x["sequence_id"]] = (x["tier"], x["step_group"])
        size[x["sequence_id"]] = size.get(x["sequence_id"], 0) + x["length"]
    tiers = {t for t, _ in windows.values()}
    groups = {g for _, g in windows.values()}
    assert tiers >= {512, 1024, 4096} and len(groups) > 3
    for t in tiers:
        share = [sum(w == (t, g) for w in windows.values()) for g in groups]
        assert max(share) - min(share) <= 1
    full = [s for i, s in size.items() if s != windows[i][0]]
    assert len(full) <= 0.05 * len(size)


# --- op5 -----------------------------------------------------------------------------
def test_masks_hit_every_item_with_a_fifth_changed():
    assert all("0" in m for m in decontam.MASKS)
    for size in range(decontam.LEAST, 21):
        for gone in itertools.combinations(range(size), int(size * 0.2 + 1e-9)):
            assert any(all(p + j not in gone for j, c in enumerate(m) if c == "1") for m in decontam.MASKS for p in range(size - len(m) + 1))


def test_leaks_equal_brute_force(spark):
    r = random.Random(8)
    items = [(i, " ".join(words(n, 200 + i, 10**6))) for i, n in enumerate((1, 3, 5, 6, 8, 15, 21, 40))] + [(50, None), (51, ""), (52, " ".join(words(15, 205, 10**6)))]
    rows = [(i, " ".join(words(60, i))) for i in range(10)]
    for i, (_, t) in enumerate(items[:8]):
        w = t.split()
        changed = list(w)
        for j in r.sample(range(len(w)), int(len(w) * 0.2)):
            changed[j] = "zz"
        rows.append((100 + i, " ".join(words(20, i) + changed + words(5, i))))
        more = list(w)
        for j in r.sample(range(len(w)), int(len(w) * 0.2) + 1):
            more[j] = "zz"
        rows.append((200 + i, " ".join(words(20, i) + more)))
    rows += [(300, None), (301, ""), (302, items[7][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def plain(d, t):
        d, t = (d or "").lower().split(), (t or "").lower().split()
        return max((sum(d[s + j] == t[j] for j in range(len(t)) if 0 <= s + j < len(d)) for s in range(-len(t), len(d))), default=0) if t else -1

    want = {(i, k): plain(d, t) for i, d in rows for k, t in items if t and plain(d, t) >= len(t.split()) * 0.8 - 1e-9}
    got = {(x["doc_id"], x["item_id"]): x["matched"] for x in decontam.leaks(docs(spark, rows, extra=True), bench).collect()}
    assert got == want
    left = {x["doc_id"] for x in decontam.without_leaks(docs(spark, rows), bench).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.leaks(docs(spark, []), bench).count() == 0
    assert decontam.leaks(docs(spark, rows), bench.limit(0)).count() == 0


# --- op6 -----------------------------------------------------------------------------
def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 6):
        s = rng.normal(size=(n, 3)).astype(np.float32)
        path = langid.viterbi(s, np.array([0, n]), 0.7)
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        assert value(path.tolist()) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=n)), abs=1e-4)
    s = rng.normal(size=(700, 4)).astype(np.float32)
    at = np.array([0, 0, 300, 301, 700])
    whole = np.concatenate([langid.viterbi(s[a:b], np.array([0, b - a]), 1.0) for a, b in zip(at, at[1:]) if b > a])
    assert (langid.viterbi(s, at, 1.0) == whole).all()


def test_languages_are_told_on_held_out_documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(-1, None, None, None, None), (-2, "123 !!", None, None, None), (-3, "", None, None, None), (None, "the of", None, None, None)], d.schema)
    got = langid.predict(d.union(more)).join(d.select("doc_id", "lang"), "doc_id", "left").collect()
    own = [r for r in got if r["lang"] and r["held_out"]]
    assert len(got) == d.count() + 4 and sum(r["lang"] == r["lang_pred"] for r in own) >= 0.95 * len(own)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] is not None and r["doc_id"] < 0)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.predict(d.limit(0)).count() == 0


# --- op7 -----------------------------------------------------------------------------
def plain_lines(rows):
    seen, pairs, out = set(), set(), {}
    for i, t in sorted(((i, t) for i, t in rows if t is not None)):
        lines = t.split("\n")
        idx = [k for k, x in enumerate(lines) if x.strip(linededup.BLANKS)]
        x = [lines[k].strip(linededup.BLANKS) for k in idx]
        gone = set()
        for a in range(len(x)):
            if x[a] in seen and (" " in x[a] or "\t" in x[a]):
                gone.add(idx[a])
            seen.add(x[a])
        for a in range(len(x) - 1):
            if (x[a], x[a + 1]) in pairs:
                gone |= {idx[a], idx[a + 1]}
            pairs.add((x[a], x[a + 1]))
        out[i] = "\n".join(v for k, v in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(6)
    pool = [f"line {i}" for i in range(12)] + ["one", "two", "", "  line 1 ", "tab\tline"]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.4 else f"own {i} {j}" for j in range(r.randrange(0, 14)))) for i in range(40)]
    rows += [(90, "aa bb\ncc dd\nee ff\nunique z\nuno"), (91, "aa bb\ncc dd\nee ff\nunique y\nuno"), (100, rows[3][1]), (101, "\n".join(["same row"] * 7)), (102, "\n".join(f"long run {k}" for k in range(70))), (103, "x y\n" + "\n".join(f"long run {k}" for k in range(70))), (104, None), (105, "")]
    got = {x["doc_id"]: x["text"] for x in linededup.without_repeats(docs(spark, rows, extra=True)).collect()}
    assert {i: t for i, t in got.items() if t is not None} == plain_lines(rows) and got[104] is None
    at, rounds = linededup.repeated_runs(docs(spark, rows))
    assert at.agg(F.max("depth")).first()[0] == 70 and rounds >= 6
    assert linededup.line_report(docs(spark, [])).count() == 0


def test_suffix_ranks_order_all_suffixes(spark):
    rows = [(1, "a b\nc d\na b\nc d\ne f"), (2, "a b\nc d\ne f"), (3, "c d\na b")]
    at, _ = linededup.repeated_runs(docs(spark, rows))
    got = at.orderBy("doc_id", "ord").select("rank").collect()
    lines = [t.split("\n") for _, t in rows]
    suffixes = [tuple(x[i:]) for x in lines for i in range(len(x))]
    # equal suffixes have equal ranks, and a rank is the number of smaller suffixes in some order of the lines
    ranks = [r["rank"] for r in got]
    assert all((ranks[i] == ranks[j]) == (suffixes[i] == suffixes[j]) for i in range(len(ranks)) for j in range(len(ranks)))
    assert any([sum(tuple(map(p.index, s)) < tuple(map(p.index, t)) for s in suffixes) for t in suffixes] == ranks for p in itertools.permutations(["a b", "c d", "e f"]))


# --- op8 -----------------------------------------------------------------------------
def test_shards_have_exact_sizes_and_gapless_slots(spark):
    rows = [(i % 40 if i % 3 else None, None if i % 11 == 0 else "x" * (i % 5)) for i in range(500)]
    for n in (1, 7, 24):
        got = sharding.shuffle_to_shards(docs(spark, rows, extra=True).repartition(6), n).collect()
        by = {}
        for r in got:
            by.setdefault(r["shard"], []).append(r["slot"])
        assert len(got) == 500 and sorted(by) == list(range(n))
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_report(docs(spark, [])).count() == 0
    r = sharding.shard_report(docs(spark, [(1, "é"), (2, None)])).orderBy("doc_id").collect()
    assert [x["size"] for x in r] == [10, 8] and r[0]["text_crc32"] == zlib.crc32("é".encode()) and r[1]["text_crc32"] == 0


def test_communication_matrix_follows_its_law():
    sums = np.zeros((3, 2))
    for seed in range(400):
        m = sharding.communication_matrix([10, 0, 30], [25, 15], seed)
        assert m.sum(axis=1).tolist() == [10, 0, 30] and m.sum(axis=0).tolist() == [25, 15]
        sums += m
    assert sums[0, 0] / 400 == pytest.approx(10 * 25 / 40, abs=0.3)
    big = sharding.communication_matrix([2 * 10**12, 10**12], [10**12, 2 * 10**12], 1)
    assert big.sum(axis=0).tolist() == [10**12, 2 * 10**12] and big.sum(axis=1).tolist() == [2 * 10**12, 10**12]


@pytest.mark.parametrize("good,bad,draws", [(5, 7, 6), (30, 10, 20), (1, 50, 3), (3, 3, 3), (200, 300, 100)])
def test_hypergeometric_draws_follow_the_law(good, bad, draws):
    rng, n = random.Random(7), 20000
    got = [sharding.hypergeometric(rng, good, bad, draws) for _ in range(n)]
    law = {k: math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) for k in range(max(0, draws - bad), min(good, draws) + 1)}
    cells = {k: p * n for k, p in law.items() if p * n > 5}
    chi = sum((got.count(k) - e) ** 2 / e for k, e in cells.items())
    assert set(got) <= set(law) and chi < len(cells) + 5 * (2 * len(cells)) ** 0.5


def test_hypergeometric_of_huge_populations():
    rng, n = random.Random(8), 3000
    good, bad, draws = 4 * 10**11, 96 * 10**11, 10**9
    got = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(n)], float)
    mean = draws * 0.04
    sd = (mean * 0.96 * (1 - draws / (good + bad))) ** 0.5
    assert abs(got.mean() - mean) < 4 * sd / n**0.5 and got.std() == pytest.approx(sd, rel=0.06)
    assert sharding.hypergeometric(rng, 10**13, 5, 10**13 + 3) in range(10**13 - 2, 10**13 + 1)


# --- op9 -----------------------------------------------------------------------------
def test_poor_and_toxic_documents_are_rejected(spark):
    good = [(i, " ".join(words(80, i, 300))) for i in range(300)]
    poor = [(1000 + i, "%%% ".join(words(60, i, 300))) for i in range(60)]
    toxic = [(2000 + i, " ".join(words(40, i, 300) + ["idiot", "stupid"] + words(40, i + 1, 300) + ["moron"])) for i in range(60)]
    labels = [(i, 1, 0) for i, _ in good[::2]] + [(i, 0, 0) for i, _ in poor[::2]] + [(i, 1, 1) for i, _ in toxic[::2]] + [(5, None, 0), (None, 1, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs(spark, good + poor + toxic + [(9000, None), (9001, "")], extra=True)
    kept = {r["doc_id"] for r in quality.resample(d, lab).collect()}
    assert not kept & {i for i, _ in poor + toxic}
    assert len(kept & {i for i, _ in good}) >= 0.98 * len(good)
    assert {r["doc_id"] for r in quality.accepted(d, lab).collect()} - kept <= {9000, 9001} | {i for i, _ in good}
    assert quality.resample(docs(spark, []), lab).count() == 0
    assert quality.resample(docs(spark, good[:5]), lab.limit(0)).count() == 5
    assert quality.resample(docs(spark, good), lab, k=17).count() == 17


def test_kth_finds_the_kth_value(spark):
    r = random.Random(2)
    xs = [(r.choice([r.random(), 0.5, -1e6 * r.random()]), i) for i in range(9000)]
    df = spark.createDataFrame(xs, "key double, uid long").cache()
    order = sorted((x for x, _ in xs), reverse=True)
    for k in (1, 2500, 4000, 9000):
        assert select.kth(df, "key", k) == order[k - 1]
    assert select.kth(df, "key", 9001) is None


def test_inclusion_follows_the_weights(spark):
    weight = {1: 1.0, 2: 2.0, 3: 5.0}
    rows = spark.range(6000).withColumnRenamed("id", "seed").crossJoin(spark.createDataFrame(list(weight.items()), "doc_id long, w double"))
    keyed = rows.withColumn("key", F.log("w") + quality.gumbel(F.col("seed"), "doc_id"))
    first = {r["id"]: r["count"] for r in keyed.groupBy("seed").agg(F.max_by("doc_id", "key").alias("id")).groupBy("id").count().collect()}
    assert all(first[i] / 6000 == pytest.approx(w / 8, abs=0.02) for i, w in weight.items())
    # the second of two draws without replacement
    second = {r["id"]: r["count"] for r in keyed.groupBy("seed").agg(F.min_by("doc_id", "key").alias("id")).groupBy("id").count().collect()}
    left_out = {a: sum(weight[b] / 8 * weight[c] / (8 - weight[b]) for b in weight for c in weight if len({a, b, c}) == 3) for a in weight}
    assert all(second[i] / 6000 == pytest.approx(p, abs=0.02) for i, p in left_out.items())


def test_ratios_say_nothing_of_usual_and_of_unknown_features():
    target = np.array([0, 1000, 100, 0, 0])
    raw = np.array([0, 1250, 125, 400, 2])
    got = quality.log_ratios(target, raw, 0.8)
    assert got[0] == 0 and abs(got[1]) < 0.05 and abs(got[2]) < 0.05 and got[3] < -3 and -0.5 < got[4] < 0
    assert quality.best_cut(np.array([-9.0, -8.0, 0.0, 1.0]), np.array([0, 0, 1, 1])) == -4.0
    assert quality.best_cut(np.array([]), np.array([])) == -np.inf


# --- op10 ----------------------------------------------------------------------------
def test_top_k_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-0.5, 0.25, 0.3, 0.7]) for _ in range(4)]) for i in range(260)] + [(300, None), (350, [0.1, None, 0.2, 0.3]), (400, [float("nan")] * 4), (450, []), (500, [0.5, 0.5]), (501, [0.5, 0.1]), (None, [0.1] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(9)).withColumn("b", F.lit(9))
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in top_k(df, F.pmod("vec_id", F.lit(50)) == 0).collect()}
    good = {i: np.floor(256 * np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v and all(x is not None and x == x for x in v)}
    want = {}
    for q in [i for i in good if i % 50 == 0]:
        best = sorted(((-int(good[q] @ good[c]), c) for c in good if c != q and len(good[c]) == len(good[q])))[:5]
        want |= {(q, n + 1): (c, -s) for n, (s, c) in enumerate(best)}
    assert got == want
    assert top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [3e5, 1.0]), (50, [-2e6, 4e5]), (1, [2e6, 1.0]), (2, [3e6, -7.5]), (3, [1.0, 1.0]), (4, [1e30, 1.0]), (5, [-1e30, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    clip = lambda x: max(min(x, 2**63 - 1), 1 - 2**63)
    want = {}
    for q in (0, 50):
        best = sorted((-clip(sum(a * b for a, b in zip(whole[q], whole[c]))), c) for c in whole if c != q)[:5]
        want |= {(q, n + 1): (c, -s) for n, (s, c) in enumerate(best)}
    assert {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in top_k(df, F.pmod("vec_id", F.lit(50)) == 0).collect()} == want
