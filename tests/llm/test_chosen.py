"""The chosen-path join against all pairs of plain sets."""

import random

import numpy as np
import pytest
from helpers import documents, edge_docs, prose

from wattline.llm import chosen


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\r\x0b\x0c" else c for c in text or "")
    return [w for w in low.split(" ") if w]


def plain_set(text):
    w = words(text)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [plain_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    out = [(r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]
    return sorted([(*x, x[0] == x[2]) for x in out], key=str)


def changed(rnd, text, n):
    w = text.split()
    for i in rnd.sample(range(len(w)), n):
        w[i] = f"new{rnd.random()}"
    return " ".join(w)


def sample():
    rnd = random.Random(13)
    rows = edge_docs(rnd) + [(100 + i, prose(rnd, 60 + i, 2000, seed=i), "en", "s", 0) for i in range(40)]
    for i in range(8):  # families around and on both sides of the threshold
        base = prose(rnd, 200, 3000, seed=70 + i)
        rows += [(200 + 20 * i + k, changed(rnd, base, k), "en", "s", 0) for k in range(14)]
    base = prose(rnd, 300, 3000, seed=90)
    rows += [(500 + k, changed(rnd, base, 1 + k % 3), "en", "s", 0) for k in range(60)]  # a large group of near copies
    passage = prose(rnd, 80, 3000, seed=91)
    rows += [(600 + k, passage + " " + prose(rnd, 60, 3000, seed=200 + k), "en", "s", 0) for k in range(50)]  # a passage that many share
    star = prose(rnd, 250, 3000, seed=93)  # alike to one text only: two of its changed copies are under the threshold
    rows += [(1000, star, "en", "s", 0)] + [(1001 + k, changed(rnd, star, 6), "en", "s", 0) for k in range(50)]
    half = prose(rnd, 150, 3000, seed=92)
    rows += [(700 + k, changed(rnd, half, 18), "en", "s", 0) for k in range(40)]  # alike, but under the threshold
    rows += [(800 + k, rows[60][1].upper(), "en", "s", 0) for k in range(20)]  # one set
    return rows + [(900, "a b", "en", "s", 0), (901, "A  b\n", "en", "s", 0), (902, "a b c", "en", "s", 0), (903, "b a", "en", "s", 0), (903, "b a", "en", "s", 0)]


@pytest.mark.parametrize("node, depth", [(128, 12), (8, 12), (8, 1)])
def test_components_match_all_pairs(spark, monkeypatch, node, depth):
    monkeypatch.setattr(chosen.set_links, "__defaults__", (4, node, depth))
    rows = sample()
    extra = documents(spark, rows, clashing=True).selectExpr("*", "1 as n", "2 as record", "'x' as digest", "3 as k1", "4 as first")
    got = chosen.near_duplicates(extra, node=node)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = [(*r[:3], r[0] == r[2]) for r in brute(rows)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_shingles_are_those_of_the_words():
    texts = ["", "a", "a b c d", "A B C D e", "a b c d a b c d", "  é  b ", "a b c", None, "x " * 50]
    raw = [None if t is None else t.encode() for t in texts]
    hashes, n = chosen.shingle_hashes(raw)
    assert n.tolist() == [max(len(words(t)) - 3, min(len(words(t)), 1)) for t in texts]
    sets = [set(x.tolist()) for x in np.split(hashes, np.cumsum(n)[:-1])]
    plain = [plain_set(t) for t in texts]
    for a, p in zip(sets, plain, strict=True):
        assert len(a) == len(p)
        for b, q in zip(sets, plain, strict=True):
            assert len(a & b) == len(p & q)


def test_empty_table(spark):
    assert chosen.near_duplicates(documents(spark, [])).collect() == []
    got = chosen.near_duplicates(documents(spark, [(None, "a b", None, None, 0), (4, None, None, None, 0), (None, "", None, None, 0)])).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(4, 0, 4, True), (None, 0, None, True), (None, 1, None, True)]


def test_minwise_values_agree_as_often_as_sets_do(spark):
    rnd = random.Random(3)
    base = prose(rnd, 400, 4000, seed=5)
    rows = [(i, changed(rnd, base, 10)) for i in range(60)]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.lit(1).alias("k1"), F.lit(1).alias("k2"), "text")
    found = sorted(chosen._described(docs, 4).collect(), key=lambda r: r["doc_id"])
    signature, sets = np.array([r["signature"] for r in found]), [plain_set(t) for _, t in rows]
    gaps = [(signature[i] == signature[j]).mean() - len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(60) for j in range(i)]
    assert abs(np.mean(gaps)) < 0.03 and np.std(gaps) < 0.09


@pytest.mark.parametrize("size", [1, 2, 1000])
def test_runs_of_keys_go_over_batches(size):
    import pyarrow as pa

    keys = [1, 1, 1, 2, 3, 3, 5]
    table = pa.table({"k": pa.array(keys, pa.int64()), "x": list(range(7))})
    runs = [t["x"].to_pylist() for t in chosen._by_key(iter(table.to_batches(max_chunksize=size)), ["k"])]
    assert runs == [[0, 1, 2], [3], [4, 5], [6]]


def test_similar_pairs_of_small_and_of_large_clusters(monkeypatch):
    rnd = np.random.default_rng(5)
    base = np.arange(400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rnd.choice(base, 380 - i, replace=False), base[: i] + np.uint64(1000 * i)])) for i in range(30)]
    plain = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert chosen.overlaps(sets, most=900).tolist() == chosen.overlaps(sets).tolist() == plain
    union = [[len(np.union1d(a, b)) for b in sets] for a in sets]
    want = {(i, j) for i in range(30) for j in range(i) if 100 * plain[i][j] >= 80 * union[i][j]}
    assert want and want == set(chosen.similar_pairs(sets))
    monkeypatch.setattr(chosen, "MATRIX", 10)  # too large for a product: sizes only, the caller compares
    assert want <= set(chosen.similar_pairs(sets))


@pytest.mark.parametrize("core", [0, 700])
def test_dense_groups_compare_every_open_pair(spark, core):
    rows = [(1, 900, core, 10_000, r, 10_000 if r < core else r) for r in range(900)]
    df = spark.createDataFrame(rows, "node long, size long, in_core long, core long, record long, component long")
    met = {}
    for r in chosen._dense_groups(df, 64).collect():
        met.setdefault(r["group"], []).append((r["record"], r["side"]))
    pairs = [tuple(sorted((a, b))) for g in met.values() for k, (a, s) in enumerate(g) for b, t in g[:k] if s != t or s < 0]
    assert len(pairs) == len(set(pairs)) and max(map(len, met.values())) < 400
    assert set(pairs) == {(a, b) for b in range(900) for a in range(b) if b >= core}


def test_dense_nodes_are_told_by_their_open_pairs(spark):
    def member(node, record, component, same):
        return (node, 40, record, component, [7] * same + [record * 100 + c for c in range(64 - same)])

    rows = [member(1, r, r, 33) for r in range(40)] + [member(2, r, r, 31) for r in range(40)]
    rows += [member(3, r, 5, 64) for r in range(40)]  # all linked: nothing open
    df = spark.createDataFrame(rows, "node long, size long, record long, component long, signature array<int>")
    assert [r["node"] for r in chosen._dense(df, 64).collect()] == [1]
