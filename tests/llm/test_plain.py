"""Language identification, the quality classifier, the rules' verdict and proximity matches
against plain versions: dictionaries, loops and double precision, one text at a time."""
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from qanat.llm import decontaminate, language, quality_model, quality_rules
from qanat.llm.common import read

from . import brute
from .test_operators import bag

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


# -------------------------------------------------------------- language --

def grams(text):
    b = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + text.lower().encode() + b" ")
    out = Counter()
    for n in (2, 3, 4):
        for i in range(len(b) - n + 1):
            h = int.from_bytes(b[i:i + n], "big")
            out[((h * 0x9E3779B97F4A7C15 + n) * 0xD6E8FEB86659FD93 & M64) >> 50] += 1
    return out


def mixture(g, logp, names, rounds=8):
    weight = {a: c / 9 for a, c in g.items()}
    top = {a: max(logp[x][a] for x in logp) for a in g}
    lik = {x: {a: math.exp(logp[x][a] - top[a]) for a in g} for x in names}
    share = {x: 1 / len(names) for x in names}
    blend = lambda a: sum(share[x] * lik[x][a] for x in names)
    for _ in range(rounds):
        pull = {a: weight[a] / blend(a) for a in g}
        share = {x: share[x] * sum(lik[x][a] * pull[a] for a in g) / sum(weight.values()) for x in names}
    return share, sum(weight[a] * math.log(blend(a)) for a in g), sum(weight.values())


def plain_language(rows, ask, penalty=3.0):
    """rows: (text, lang) to learn from; ask: texts. (predicted language, its share) of each."""
    counts = {}
    for text, lang in rows:
        counts.setdefault(lang, Counter()).update(grams(text))
    total = {x: sum(c.values()) + 0.5 * (1 << 14) for x, c in counts.items()}
    out = []
    for text in ask:
        if not text or not any(map(str.isalpha, text)):
            out.append(("und", 0.0))
            continue
        g = grams(text)
        logp = {x: {a: math.log((counts[x][a] + 0.5) / total[x]) for a in g} for x in counts}
        names = sorted(counts)
        share, best, weight = mixture(g, logp, names)
        cost = penalty * math.log(2 + weight)
        alone = {x: mixture(g, logp, [x], 0)[1] for x in names}
        # mixture() of one language has the same constant per n-gram as that of all only if it is taken over all
        one = max(names, key=lambda x: alone[x])
        if alone[one] + cost >= best:
            share = {one: 1.0}
        else:
            while len(names) > 1:
                fewer = [x for x in names if x != min(names, key=lambda x: share[x])]
                new, got, _ = mixture(g, logp, fewer)
                if got + cost < best:
                    break
                names, share, best = fewer, new, got
        name = max(sorted(share), key=lambda x: share[x])
        out.append((name, min(share[name], 1.0)))
    return out


def test_op3_against_plain_mixtures(spark):
    docs = [(r["doc_id"], r["text"][:3000], r["lang"]) for r in read(spark, SF, "documents").orderBy("doc_id").collect()]
    by = {x: [t for _, t, lang in docs if lang == x] for x in {lang for _, _, lang in docs}}
    names = sorted(by)
    mixed = [(1000 + 5 * i, by[names[i % 4]][i][:900] + " " + by[names[(i + 1) % 4]][i][:600], None) for i in range(12)]
    odd = [(2000, None, "en"), (2005, "", None), (2010, "12 34", "fr"), (2015, "é", None), (2015, "é", None), (None, by[names[0]][0], None)]
    rows = docs + mixed + odd
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learn = [(t, lang) for d, t, lang in rows if brute.fold(d) != 0 and t is not None and lang is not None]
    want = Counter()
    for (d, t, _), (name, share) in zip(rows, plain_language(learn, [t for _, t, _ in rows])):
        want[(d, brute.fold(d) == 0, name)] += 1
    got = language.contract(df)
    assert bag(got, "doc_id", "held_out", "lang_pred") == want
    shares = {r["doc_id"]: r["score"] for r in got.collect()}
    for (d, t, _), (name, share) in zip(rows, plain_language(learn, [t for _, t, _ in rows])):
        assert shares[d] == pytest.approx(share, abs=2e-3)
    assert sum(0.3 < shares[d] < 0.95 for d, _, _ in mixed) >= 8  # mixtures are seen as mixtures


# --------------------------------------------------------------- quality --

def measure(text):
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return dict.fromkeys(quality_model.MEASURES, 0.0)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    bare = [w.rstrip(b".,;:!?").lower() for w in words]
    bits = [bytes(c for c in w if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128)) for w in words]
    upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    return {
        "words": n, "symbols": sum(c in b"#*$%&|<>{}[]=~^\\@_" for c in raw) / n, "upper": upper / max(upper + lower, 1), "exclaim": raw.count(b"!") / n,
        "dup_lines": 1 - len(set(lines)) / len(lines), "variety": len(set(bare)) / n, "stop": sum(w in quality_model.STOP_WORDS for w in bare) / n,
        "word_length": sum(map(len, words)) / n, "packed": len(zlib.compress(raw, 1)) / len(raw) if len(raw) >= 200 else 0.5,
        "unplain": sum(bool(x) and x not in quality_model.PLAIN_ENDS for x in bits) / n, "echo": sum(a == b for a, b in zip(bare, bare[1:])) / n}


def ballots(m):
    long = m["words"] >= 20
    v = lambda bad, good=False: -1 if bad else int(good)
    return [v(m["words"] < 1), v(m["symbols"] > 0.3), v(m["upper"] > 0.6), v(m["exclaim"] > 0.3), v(m["dup_lines"] > 0.5), v(long and m["variety"] < 0.2),
            v(long and m["stop"] < 0.01, m["stop"] > 0.05), v(m["word_length"] > 20 or m["word_length"] < 2), v(m["packed"] < 0.12),
            v(long and m["unplain"] > 0.35, m["unplain"] < 0.1 or (not long and m["unplain"] < 0.6 and m["symbols"] < 0.3)), v(m["echo"] > 0.25)]


def plain_labels(votes):
    """Posterior of each row by expectation-maximisation over the rows themselves."""
    p = [1 / (1 + math.exp(-(sum(v) / 2 - 3 * v.count(-1) + 1))) for v in votes]
    for _ in range(100):
        share = min(max(sum(p) / max(len(p), 1), 0.02), 0.98)
        good = [[sum(q for q, v in zip(p, votes) if v[k] == o) + add for o, add in ((-1, 0.05), (0, 0.5), (1, 1.0))] for k in range(11)]
        bad = [[sum(1 - q for q, v in zip(p, votes) if v[k] == o) + add for o, add in ((-1, 1.0), (0, 0.5), (1, 0.5))] for k in range(11)]
        new = []
        for v in votes:
            x = math.log(share / (1 - share)) + sum(math.log(good[k][o + 1] / sum(good[k])) - math.log(bad[k][o + 1] / sum(bad[k])) for k, o in enumerate(v))
            new.append(1 / (1 + math.exp(-min(max(x, -50), 50))))
        moved = max(abs(a - b) for a, b in zip(p, new))
        p = new
        if moved < 1e-6:
            break
    return p


def plain_features(text, m):
    raw, out = text.encode(), Counter()
    shape = [65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else 128 if c >= 128 else c for c in raw]
    place = lambda x, bits: (x * 0x9E3779B97F4A7C15 & M64) >> (64 - bits)
    for seq, lo, bits in ((list(raw), 0, 14), (shape, 1 << 14, 12)):
        c = Counter(place(a << 16 | b << 8 | d, bits) for a, b, d in zip(seq, seq[1:], seq[2:]))
        for k, n in c.items():
            out[lo + k] = math.sqrt(n) / math.sqrt(len(raw) - 2)
    scale = [1, 64, 32, 64, 32, 32, 64, 2, 32, 32, 64]
    for k, (x, s) in enumerate(zip(m.values(), scale)):
        out[place(k * 16 + int(min(math.log2(1 + x * s), 15)) + 1, 8) + (1 << 14) + (1 << 12)] = 0.5
    return out


def plain_scores(texts):
    m = [measure(t) for t in texts]
    p = np.array(plain_labels([ballots(x) for x in m]))
    x = np.zeros((len(texts), quality_model.WIDTH))
    for row, t, k in zip(x, texts, m):
        for at, value in plain_features(t, k).items():
            row[at] = value
    good = min(max(p.mean(), 0.02), 0.98)
    weight = (p / good + (1 - p) / (1 - good)) / 2
    w, speed = np.zeros(quality_model.WIDTH + 1), np.zeros(quality_model.WIDTH + 1)
    for _ in range(300):
        ahead = w + 0.9 * speed
        err = weight * (1 / (1 + np.exp(-np.clip(x @ ahead[:-1] + ahead[-1], -40, 40))) - p) / len(x)
        speed = 0.9 * speed - 4.0 * (np.append(x.T @ err, err.sum()) + 1e-4 * np.append(ahead[:-1], 0))
        w = w + speed
    s = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    return p, np.where([k["words"] > 0 for k in m], s, 0.0)


def test_op8_against_plain_model(spark):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").orderBy("doc_id").collect()]
    rows += [(None, None), (5, ""), (7, " \n"), (9, "word"), (9, "word"), (11, "*** ### $$$ " * 30)]
    weak, score = plain_scores([t or "" for _, t in rows])
    got = quality_model.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    key = lambda r: (str(r[0]), round(r[1], 4), round(r[2], 2))
    a = sorted(((r["doc_id"], r["weak_score"], r["score"], r["kept"]) for r in got), key=key)
    b = sorted(((d, w, s, s >= 0.5) for (d, _), w, s in zip(rows, weak, score)), key=key)
    for x, y in zip(a, b):
        assert x[0] == y[0] and x[1] == pytest.approx(y[1], abs=1e-5) and x[2] == pytest.approx(y[2], abs=5e-3)
        assert x[3] == y[3] or abs(y[2] - 0.5) < 5e-3
    assert {r[3] for r in a} == {True, False}


def test_op8_sample_does_not_depend_on_partitions(spark):
    """More rows than the sample holds, one text a third of them: the same model however they are dealt."""
    rng = random.Random(0)
    rows = [(1, "the same text again and again with the usual words of it")] * 150
    rows += [(i, " ".join(rng.choice("the of and to in that is was for with".split()) for _ in range(30)) + " #*$%" * (i % 3 * 6)) for i in range(2, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (quality_model.fit(df.repartition(n), train=60).weights for n in (2, 7))
    assert np.abs(a - b).max() < 1e-4


# ----------------------------------------------------------------- rules --

def verdicts(text):
    n_words, chars, symbols, dup, covered, failed = brute.quality(text)
    text = text or ""
    words = brute.SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if brute.SPACE_WORD.search(x)]
    per = lambda x, n: x / n if n else 0.0
    kinds = [[unicodedata.category(c) for c in w] for w in words]
    stop = sum(re.sub(r"[.,;:!?]+$", "", w).lower() in quality_rules.STOP_WORDS for w in words)
    ends = lambda x: x.rstrip(" ").endswith(("...", "…"))
    ok = {"words": n_words >= 10, "word_length": 2 <= per(chars, n_words) <= 16, "symbols": per(symbols, n_words) <= 0.1, "stop_words": per(stop, n_words) >= 0.02,
          "repeated_lines": per(dup, len(lines)) <= 0.3, "repeated_words": per(covered, n_words) <= 0.2,
          "upper_case": per(sum(k.count("Lu") >= 2 and "Ll" not in k for k in kinds), n_words) <= 0.5,
          "bullets": per(sum(bool(re.match(r"[ \t]*[-*•]", x)) for x in lines), len(lines)) <= 0.9, "ellipses": per(sum(map(ends, lines)), len(lines)) <= 0.3}
    return (*ok.values(), not failed and all(ok.values()))


def test_op10_verdict_against_plain_rules(spark, docs, rows):
    more = [(100, "- one line of the list\n* two lines of it\n• three of the lines"), (101, "and so on...\nto be seen …\nthe end of it all is near now"),
            (102, "THE WORDS OF THIS TEXT ARE ALL IN UPPER CASE, ÉTÉ ÜBER"), (103, "a b c d e f g h i j the of"), (104, "the " + "x" * 400 + " of"),
            (105, "the same line of words\n" * 3 + "and another one that is not the same at all")]
    plain = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    every = [*rows, *more, *plain]
    df = spark.createDataFrame(every, "doc_id long, text string").repartition(4)
    columns = ["doc_id", *[f"ok_{r.name}" for r in quality_rules.RULES], "kept"]
    want = Counter((d, *verdicts(t)) for d, t in every)
    assert bag(quality_rules.quality_rules(df), *columns) == want
    for k in range(1, len(columns)):
        assert {x[k] for x in want} == {True, False}  # each rule decides somewhere


# ------------------------------------------------------------- proximity --

def near(rows, items, slop=4, width=10):
    """Items per row with two of a window's three rarest terms within slop, or with an occurrence."""
    texts = [brute.BENCH_WORD.findall((t or "").translate(brute.LOW)) for _, t in rows]
    freq = Counter(w for t in texts for w in t)
    out = []
    for (_, text), words in zip(rows, texts):
        place = {}
        for i, w in enumerate(words):
            place.setdefault(w, []).append(i)
        found = set()
        for window, ids in brute.windows(items, width).items():
            first = {w: window.index(w) for w in window}
            rare = sorted((w for w in first if freq[w]), key=lambda w: (freq[w], first[w]))[:3]
            starts = [[i - first[w] for i in place.get(w, ())] for w in rare]
            close = any(abs(a - b) <= slop for x in range(len(starts)) for y in range(x) for a in starts[x] for b in starts[y])
            exact = any(tuple(words[i:i + len(window)]) == window for i in range(len(words) - len(window) + 1))
            if exact or close and len(first) > 1:
                found |= ids
        out.append(len(found))
    return out


def test_op7_proximity_against_plain_search(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["rare", "odd", "seldom"]
    text = lambda n: " ".join(vocabulary[min(int(rng.paretovariate(0.6)) - 1, 39)] for _ in range(n))
    items = [(i, text(rng.choice([3, 10, 14]))) for i in range(6)] + [(7, "w1 w1 w1"), (8, "unheard w3 unseen w5 w7"), (9, "rare odd seldom")]
    rows = [(i, text(rng.randint(5, 60))) for i in range(40)] + [(50, "seldom x odd y rare"), (51, None), (None, "rare odd seldom"), (52, "w1 w1 w1 w1")]
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert bag(got, "doc_id", "n_near") == Counter((d, n) for (d, _), n in zip(rows, near(rows, items)))
    assert got.where("n_near < n_items").count() == 0


def test_op7_one_replaced_word_stays_near(spark):
    """Each word of a passage replaced in turn, by a word found elsewhere and by one found nowhere else."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(k, " ".join([*words[:k], "elsewhere", *words[k + 1:]])) for k in range(10)]
    rows += [(10 + k, "before it " + " ".join([*words[:k], f"new{k}", *words[k + 1:]]) + " after it") for k in range(10)]
    rows += [(20, "elsewhere and " * 5), (21, "kappa " + "q " * 30 + "alpha " + "q " * 30 + "gamma")]
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["nowhere", *words[1:]]))], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert all(got[k] == (0, 2) for k in range(20)) and got[20] == got[21] == (0, 0)


def test_op7_narrowing_keeps_the_keys(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 64)
    rows = spark.range(20_000).selectExpr("xxhash64(id) k1", "id k2")
    keys = rows.where("k2 % 100 = 7")
    kept = decontaminate.narrowed(rows, keys)
    assert kept.columns == rows.columns and kept.count() < 2_000
    assert keys.join(kept, ["k1", "k2"], "left_anti").count() == 0
    assert decontaminate.narrowed(rows, keys.limit(0)).count() == 0
