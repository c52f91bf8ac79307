import random
from collections import defaultdict

import pytest
import xxhash
from helpers import DOCS, documents, edge_docs, prose

from wattline.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_print(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return sorted(
        (str(r[0]), f"{prints[i]:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)
    )


def sample():
    rnd = random.Random(3)
    rows = edge_docs(rnd)
    for g in range(12):
        words = prose(rnd, 150).split()
        for c in range(6):
            near = list(words)
            for _ in range(c):
                near[rnd.randrange(len(near))] = "changed"
            rows.append((100 + 10 * g + c, " ".join(near), "en", "s", 0))
    return rows


def test_matches_brute_force(spark):
    rows = sample()
    got = simhash.near_duplicates(documents(spark, rows, clashing=True))
    assert sorted((str(r[0]), r[1], r[2]) for r in got.collect()) == brute_components(rows)


@pytest.mark.parametrize("bucket", [1, 64])
def test_links_find_every_pair(spark, bucket):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = {b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(6)} | set(base) | {0, (1 << 64) - 1, 1 << 63}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket=bucket)
    assert {tuple(r) for r in got.collect()} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_one_of_each_component_stays(spark):
    rows = sample()
    kept = simhash.keep_one(documents(spark, rows, clashing=True))
    groups = {c for _, _, c in brute_components(rows)}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted(groups)


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_one(empty).collect() == []
