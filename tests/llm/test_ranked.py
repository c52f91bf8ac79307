"""Ranked search against plain scores, and the trees against plain maxima."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import documents, edge_docs, prose

from wattline.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, top):
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, c, n in docs:
            m = 75 + 25 * n * n_docs // n_terms
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def sample():
    rnd = random.Random(12)
    rows = edge_docs(rnd) + [(100 + i, prose(rnd, 20 + i, seed=i % 5), "en", "s", 0) for i in range(150)]
    rows += [(400 + i, rows[20][1], "en", "s", 0) for i in range(30)]  # ties
    items = [(i, prose(rnd, 5 + i, seed=i % 5)) for i in range(12)] + [(50, None), (51, ""), (52, "Ünd 中文 ÀÉ zzz"), (None, rows[20][1]), (1, rows[20][1])]
    return rows, [*items, items[0], (60, "the only unknown words qqq"), (61, "WORD word a4 +++")]


@pytest.mark.parametrize("top, shard, terms_", [(20, 8192, 200_000), (3, 16, 30)])
def test_search_matches_plain_scores(spark, monkeypatch, top, shard, terms_):
    monkeypatch.setattr(ranked, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranked, "SLICE_TERMS", terms_)  # many passes
    rows, items = sample()
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as n", "2 as item", "3 as score")
    got = ranked.search_items(documents(spark, rows, clashing=True).selectExpr("*", "1 as n", "2 as columns"), asked, top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, items, top)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search_items(documents(spark, []), items).collect() == []
    assert ranked.search_items(documents(spark, [(1, "", None, None, 0)]), items).collect() == []
    assert ranked.search_items(documents(spark, [(1, "a b", None, None, 0)]), items.limit(0)).collect() == []


def plain(rows):
    return [dict(zip(rows.columns[a:b].tolist(), rows.values[a:b].tolist(), strict=True)) for a, b in zip(rows.indptr, rows.indptr[1:], strict=False)]


def made(rnd, n, width):
    rows = [sorted(rnd.choice(width, rnd.integers(0, 6), replace=False).tolist()) for _ in range(n)]
    flat = np.array([c for r in rows for c in r], np.int64)
    return ranked.Sparse(np.cumsum([0, *map(len, rows)]), flat, rnd.integers(1, 50, len(flat)))


@pytest.mark.parametrize("n", [0, 1, 16, 17, 150])
def test_tree_nodes_hold_the_maxima_of_all_rows_below(n):
    rows = made(np.random.default_rng(n), n, 9)
    levels = ranked.tree(rows, 9)
    under = [[i] for i in range(n)]
    for cuts, nodes in reversed(levels):
        end = [*cuts[1:], len(under)]
        under = [[i for u in under[a:b] for i in u] for a, b in zip(cuts, end, strict=True)]
        for node, members in zip(plain(nodes), under, strict=True):
            want = {}
            for i in members:
                for c, v in plain(rows)[i].items():
                    want[c] = max(v, want.get(c, 0))
            assert node == want
    assert len(levels[0][0]) == 1


def test_pruning_opens_few_pairs_and_loses_none():
    rnd = np.random.default_rng(5)
    docs, items = made(rnd, 2000, 400), made(rnd, 40, 400)
    ones = np.ones(400)
    search = ranked.Search(items, 400, 5, np.zeros(40, np.int64))
    opened = []
    offer = search._offer
    search._offer = lambda item, scores, ids: (opened.append(len(ids)), offer(item, scores, ids))
    search.meet(docs, np.arange(2000), ranked.in_order(docs, ones))
    got = Counter(zip(*(x.tolist() for x in search.found()), strict=True))
    want = Counter()
    for i, a in enumerate(plain(items)):
        scores = sorted((-sum(v * b.get(c, 0) for c, v in a.items()), j) for j, b in enumerate(plain(docs)))
        want.update((i, j, -s) for s, j in scores[:5] if s < 0)
    assert got == want and sum(opened) < 0.2 * 40 * 2000
