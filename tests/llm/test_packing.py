import random

from helpers import DOCS, documents, edge_docs, prose

from wattline.llm import packing


def test_each_piece_goes_to_a_tightest_compatible_bin():
    rnd = random.Random(1)
    for trial in range(20):
        n, capacity = 200, 64
        sizes = sorted((rnd.randint(1, capacity) for _ in range(n)), reverse=trial % 2 == 0)
        bits = [1 << rnd.randrange(3) | (1 << rnd.randrange(4, 9) if rnd.random() < 0.5 else 0) for _ in range(n)]
        room, held = {}, {}
        for (bin_, start), size, b in zip(packing.pack(sizes, bits, capacity), sizes, bits):
            free = [r for k, r in room.items() if r >= size and not held[k] & b]
            residual = room.get(bin_, capacity)
            assert start == capacity - residual
            assert (residual == min(free)) if free else bin_ not in room
            assert not held.get(bin_, 0) & b
            room[bin_], held[bin_] = residual - size, held.get(bin_, 0) | b


def sample():
    rnd = random.Random(8)
    rows = edge_docs(rnd)
    rows += [(100 + i, prose(rnd, rnd.randint(5, 400)), "en", "hot" if i % 3 else f"s{i}", 0) for i in range(300)]
    rows += [(500 + i, rows[20][1], "en", f"t{i}", 0) for i in range(30)]
    return rows


def test_packing_is_whole_and_without_conflicts(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 100)
    rows = sample()
    capacity = 2048
    got = packing.pack_documents(documents(spark, rows, clashing=True), capacity=capacity).collect()
    total = sum(len((r[1] or "").encode()) for r in rows)
    assert sum(r["n_tokens"] for r in got) == total
    assert all((r["bin_id"] is None) == (r["n_tokens"] == 0) for r in got)
    source, text = {r[0]: r[3] for r in rows}, {r[0]: r[1] for r in rows}
    sizes = {}
    for r in got:
        sizes.setdefault(r["doc_id"], []).append((r["piece"], r["text_start"], r["n_tokens"]))
    for i in range(100, 400):
        n = len(text[i].encode())
        assert sorted(sizes[i]) == [(k, k * capacity, min(capacity, n - k * capacity)) for k in range(max(1, -(-n // capacity)))]
    bins = {}
    for r in got:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r["bin_start"]):
            assert r["bin_start"] == at
            at += r["n_tokens"]
        assert at <= capacity
        known = [source[r["doc_id"]] for r in members if source[r["doc_id"]] is not None]
        assert len(known) == len(set(known))
        texts = [" ".join(text[r["doc_id"]].lower().split()) for r in members if r["doc_id"] is not None]
        assert len(texts) == len(set(texts))


def test_null_sources_and_wide_ids_leave_bins_tight(spark):
    rnd = random.Random(3)
    rows = [(2**60 + i, prose(rnd, rnd.randint(3, 90)), "en", f"s{i % 400}" if i % 50 else None, 0) for i in range(1200)]
    rows.append((None, prose(rnd, 40), "en", None, 0))
    got = packing.pack_documents(documents(spark, rows), capacity=2048).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    order = sorted(rows, key=lambda r: -len(r[1]))
    number = {s: i for i, s in enumerate({r[3] for r in rows} - {None})}
    exact = packing.pack([len(r[1]) for r in order], [1 << number[r[3]] if r[3] else 0 for r in order], 2048)
    bins = len({r["bin_id"] for r in got})
    assert bins <= 1.05 * len({b for b, _ in exact}), (bins, len({b for b, _ in exact}))


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).collect() == []
