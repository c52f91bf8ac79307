import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from helpers import DOCS, documents, edge_docs, prose

from wattline.llm import points, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(hit), failed


def sample():
    rnd = random.Random(4)
    rows = edge_docs(rnd)
    rows += [(100 + i, prose(rnd, 60 + i % 90), "en" if i % 3 else "de", "s", 0) for i in range(250)]
    rows += [(900 + i, " ".join(w + rnd.choice(["%%%", "&&&", "###"]) for w in prose(rnd, 90).split()), "en", "s", 0) for i in range(4)]
    rows += [(950, "line one two\n" * 3 + prose(rnd, 70) + "\n \nline one two\r\n", "en", "s", 0)]
    return rows


def brute_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries."""
    counts = {quality.ORDER: Counter(g for t in texts if t for g in quality.codes(t.encode()).tolist())}
    n = quality.CLASSES
    for order in range(quality.ORDER - 1, 0, -1):
        counts[order] = Counter(g % n**order for g in counts[order + 1])

    tables = {}
    for order, grams in counts.items():
        n1, n2, n3, n4 = (max(1, sum(v == k for v in grams.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cut = [0, *(min(max(0.05, k - (k + 1) * y * b / a), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
        mass, left = defaultdict(int), defaultdict(float)
        for g, v in grams.items():
            mass[g // n] += v
            left[g // n] += min(cut[min(v, 3)], v)
        tables[order] = (grams, cut, mass, left)

    def prob(g, order):
        if order == 0:
            return 1 / n
        g %= n**order
        grams, cut, mass, left = tables[order]
        lower = prob(g, order - 1)
        if not mass[g // n]:
            return lower
        v = grams.get(g, 0)
        return (v - min(cut[min(v, 3)], v)) / mass[g // n] + left[g // n] / mass[g // n] * lower

    return prob


def test_model_matches_brute_force_and_sums_to_one(spark):
    texts = [r[1] for r in sample()]
    model = quality.fit_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    prob = brute_model(texts)
    rnd = np.random.default_rng(0)
    some = np.concatenate([rnd.integers(0, 32**4, 300), *[quality.codes(t.encode())[:40] for t in texts if t]])
    want = [math.log(prob(int(g), quality.ORDER)) for g in some]
    assert np.allclose(model.log_prob(some), want, atol=1e-9)
    for context in (some // 32)[-50:]:
        assert abs(np.exp(model.log_prob(context * 32 + np.arange(32))).sum() - 1) < 1e-9


def test_rules_match_brute_force(spark):
    rows = sample()
    got = quality.quality_rules(documents(spark, rows, clashing=True)).collect()
    assert sorted((str(r["doc_id"]), *r[1:7]) for r in got) == sorted((str(r[0]), *brute_base(r[1])) for r in rows)
    prob = brute_model([r[1] for r in rows])
    cache = {}
    text_of = {r[0]: r[1] for r in rows}
    for r in got:
        assert r["kept"] <= (not r["base_failed"])
        if r["kept"]:
            assert r["low"] <= r["nats_per_byte"] <= r["high"]
        if r["doc_id"] in (100, 900, 11):
            nats = [-cache.setdefault(g, math.log(prob(g, quality.ORDER))) for g in quality.codes(text_of[r["doc_id"]].encode()).tolist()]
            assert abs(r["nats_per_byte"] - sum(nats) / len(nats)) < 1e-9
    verdict = {r["doc_id"]: r["kept"] for r in got}
    assert not any(verdict[900 + i] for i in range(4))
    assert np.mean([verdict[100 + i] for i in range(250)]) > 0.98


def test_rare_languages_have_bands_of_their_own_at_every_size(spark):
    rnd = np.random.default_rng(2)
    many = [("en", float(x)) for x in rnd.normal(2, 0.1, 2000)]
    rare = [("xx", float(x)) for x in rnd.normal(3.5, 0.1, 100)]

    def of(n):
        scores = spark.createDataFrame([*many, *rare[:n]], "lang string, nats double")
        return {r["lang"]: (r["low"], r["high"]) for r in quality.language_bands(scores).collect()}["xx"]

    for n in (1, 3, 30, 99):
        low, high = of(n)
        assert all(low <= x <= high for _, x in rare[:n]) and low > 2.2
    assert np.allclose(of(99), of(100), atol=0.02)


def test_clean_texts_of_a_rare_language_are_kept(spark):
    rnd = random.Random(6)
    rows = [(i, prose(rnd, 90), "en", "s", 0) for i in range(600)]
    letters = str.maketrans("aeinorstu", "äëïñöřßţü")
    rows += [(1000 + i, prose(rnd, 90, seed=2).translate(letters), "xx", "s", 0) for i in range(40)]
    kept = {r["doc_id"] for r in quality.keep_good(documents(spark, rows)).collect()}
    assert len([i for i in kept if i >= 1000]) >= 39


def test_point_scores_match_brute_force(spark):
    texts = [r[1] for r in sample()[-60:]] + ["ÀÉ ñ 中文", "", None, "a"]
    got = points.point_scores(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "text", "nats", sum(len((t or "").encode()) for t in texts))
    n = Counter()
    marked = [[-1] * 3 + points.points((t or "").encode()).tolist() + [-2] for t in texts]
    for t in marked:
        n[()] += len(t) - 3
        n.update(tuple(t[i + 1 - k : i + 1]) for i in range(2, len(t)) for k in range(1, 5) if k <= i + 1)
    for r in got.collect():
        if not texts[r["i"]]:
            assert r["nats"] is None
            continue
        t, total = marked[r["i"]], 0.0
        for i in range(3, len(t)):
            p = 1 / 0x110002
            for k in range(1, 5):
                gram = tuple(t[i + 1 - k : i + 1])
                p = (n[gram] - 1 + 5 * p) / (n[gram[:-1]] - 1 + 5)
            total -= math.log(p)
        assert abs(r["nats"] - total / (len(t) - 3)) < 1e-6


def test_scrambled_words_without_latin_letters_are_rejected(spark):
    rnd = random.Random(9)
    script = str.maketrans("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ")
    rows = [(i, prose(rnd, 90).translate(script), "ru", "s", 0) for i in range(300)]
    for i in range(10):  # the same word lengths, spaces and marks, so the same byte classes
        text = prose(rnd, 90).translate(script)
        rows.append((1000 + i, "".join(chr(rnd.randrange(0x430, 0x44A)) if c.isalpha() else c for c in text), "ru", "s", 0))
    kept = {r["doc_id"] for r in quality.keep_good(documents(spark, rows)).collect()}
    assert not [i for i in kept if i >= 1000] and len(kept) >= 297


def test_copies_of_a_clean_text_are_left_to_the_duplicate_stage(spark):
    rnd = random.Random(12)
    rows = [(i, prose(rnd, 90, vocabulary=3000), "en", "s", 0) for i in range(300)]
    rows += [(1000 + i, rows[5][1], "en", "s", 0) for i in range(60)]
    got = quality._judged(quality._scored(documents(spark, rows).select("doc_id", "text", "lang"), "text")).collect()
    for r in got:
        if r["doc_id"] >= 1000 and r["low"] <= r["nats"] <= r["high"]:
            assert r["kept"]


def test_keep_good_returns_whole_rows(spark):
    rows = sample()
    docs = documents(spark, rows, clashing=True)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in quality.quality_rules(docs).collect() if r["kept"]}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert quality.quality_rules(empty).collect() == [] and quality.keep_good(empty).collect() == []
