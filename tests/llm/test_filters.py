"""The filter audit against a plain count, and the matrix under it."""

import random
from itertools import permutations

import numpy as np
from helpers import documents, edge_docs, prose

from wattline.llm import filters


def sample():
    rnd = random.Random(11)
    rows = edge_docs(rnd) + [(100 + i, prose(rnd, 150 + 3 * i, 900, seed=i % 3) + " #" * (i % 5 == 0) + " ABCDEF" * (i % 7), "en", f"s{i % 2}", 0) for i in range(60)]
    return rows + [(300 + i, rows[20][1], "en", "s1", 0) for i in range(9)] + [(99, rows[20][1], "en", "s0", 0)]


def brute(rows, labels):
    words = lambda t: "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in t).split(" ")
    docs = []
    for i, t, _, s, *_ in rows:
        t, w = t or "", [x for x in words(t or "") if x]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in t for c in "#$%&*|"), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows),
        }
        docs.append((s or "", fails, any(q == 1 and k == i for k, q, _ in labels if i is not None), any(x == 1 and k == i for k, _, x in labels if i is not None)))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        told = []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                open_ = [d for d in own if not any(d[1][g] for g in order[:k])]
                gone = [d for d in open_ if d[1][f]]
                shapley[f] += len(gone)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                told.append((part, "".join(order), k + 1, len(open_) - len(gone), len(gone), sum(d[1][f] for d in own) - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone), f))
        out += [(*t[:-1], shapley[t[-1]]) for t in told]
    return sorted(out)


def test_audit_matches_a_plain_count(spark):
    rows = sample()
    labels = [(100 + i, i % 2, i % 3 == 0) for i in range(40)] + [(100, 1, 0), (None, 1, 1), (301, 1, 1), (101, None, None)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as failed", "2 as n")
    got = filters.audit_filters(documents(spark, rows, clashing=True).selectExpr("*", "1 as digest", "2 as failed", "3 as part"), table)
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, labels)


def test_matrix_is_numbered_over_all_shards(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["b a a", "", None, "c  a\tc", "é é a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as source").repartition(3, "doc_id")
    shards, words = filters.document_term_matrix(docs)
    name = {r["id"]: bytes(r["word"]).decode() for r in words.collect()}
    assert sorted(name) == [0, 1, 2, 3] and set(name.values()) == {"a", "b", "c", "é"}
    got = {}
    for r in shards.collect():
        indptr, indices, data = (filters.unpacked(bytes(r[c])) for c in ("indptr", "indices", "data"))
        for i, doc in enumerate(r["doc_id"]):
            got[doc] = {name[j]: n for j, n in zip(indices[indptr[i] : indptr[i + 1]].tolist(), data[indptr[i] : indptr[i + 1]].tolist(), strict=True)}
    assert got == {0: {"b": 1, "a": 2}, 1: {}, 2: {}, 3: {"c": 2, "a": 1}, 4: {"é": 2, "a": 1}}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit_filters(documents(spark, []), none).collect() == []
    got = filters.audit_filters(documents(spark, [(1, None, None, None, None)]), none).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r["part"], r["removed"], r["kept"]) for r in got] == [("", 1, 0)] + [("", 0, 0)] * 4


def test_packed_round_trip():
    for x in (np.zeros(0, np.int64), np.array([0, 255]), np.array([256, 1, 65536]), np.array([1 << 40, 3])):
        assert filters.unpacked(filters.packed(x)).tolist() == x.tolist()
