import math
import random
import zlib
from collections import Counter

import pytest
from helpers import DOCS, documents, edge_docs, prose

from wattline.llm import backoff


def words_of(text):
    return [*(text or "").encode().lower().split(), "END"]


def brute(rows):
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    single, pair = Counter(), Counter()
    for r, h in zip(rows, held):
        if not h:
            w = words_of(r[1])
            single.update(w)
            pair.update(zip(["START", *w], w))
    n, v = sum(single.values()), len(single)
    z = n + v + 1
    history = single + Counter({"START": held.count(False)})
    m = backoff.SMOOTHING
    out = []
    for r, h in zip(rows, held):
        w = words_of(r[1])
        base = sum(math.log10((single[x] + 1) / z) for x in w)
        score = 0.0
        state = "START"
        for x in w:
            if pair[state, x]:
                score += math.log10((pair[state, x] + m * (single[x] + 1) / z) / (history[state] + m))
            else:
                score += math.log10(m / (history[state] + m)) + math.log10((single[x] + 1) / z)
            state = x
        out.append((str(r[0]), h, len(w), sum(single[x] > 0 for x in w), n, base, score))
    return sorted(out, key=str)


def sample():
    rnd = random.Random(7)
    rows = edge_docs(rnd) + [(300 + i, prose(rnd, 5 + i % 50), "en", "s", 0) for i in range(200)]
    return rows + [(600, "Ab AB\x0bab\x1cab é É " + "y" * 3000, "en", "s", 0)]


@pytest.mark.parametrize("size", [backoff.BLOCK_BYTES, 4000])
def test_scores_match_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", size)
    monkeypatch.setattr(backoff, "RANGE_BYTES", size)
    rows = sample()
    got = sorted(((str(r[0]), *r[1:]) for r in backoff.backoff_scores(documents(spark, rows, clashing=True)).collect()), key=str)
    want = brute(rows)
    assert [g[:5] for g in sorted(got)] == [w[:5] for w in sorted(want)]
    for g, w in zip(sorted(got), sorted(want)):
        assert abs(g[5] - w[5]) < 1e-6 * (1 + abs(w[5])) and abs(g[6] - w[6]) < 1e-6 * (1 + abs(w[6]))


def test_each_history_sums_to_one():
    texts = [b"a b a c", b"a b", b"c"]
    single, pair = Counter(), Counter()
    for t in texts:
        w = words_of(t.decode())
        single.update(w)
        pair.update(zip(["START", *w], w))
    z, m = sum(single.values()) + len(single) + 1, backoff.SMOOTHING
    for state, n in [("a", single["a"]), ("START", 3), ("b", single["b"])]:
        total = sum((pair[state, x] + m * (single[x] + 1) / z) / (n + m) for x in single)
        assert abs(total + m / (n + m) / z - 1) < 1e-12  # the rest is the share of an unseen word


def test_no_training_document_and_empty_table(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    got = backoff.backoff_scores(documents(spark, [(i, "a b", "en", "s", 3) for i in held])).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 2
    assert backoff.backoff_scores(spark.createDataFrame([], DOCS)).collect() == []
