import collections
import hashlib
import random

import numpy as np
import pytest
from helpers import DOCS, documents, edge_docs, prose

from wattline.llm import induced, suffix


def brute(texts, length=suffix.LENGTH):
    raw = [(t or "").encode() for t in texts]
    counts = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("symbols", [1, 2, 3, 20, 200])
def test_suffix_array_and_prefixes(symbols):
    rnd = np.random.default_rng(symbols)
    for trial in range(60):
        s = np.append(rnd.integers(1, symbols + 1, rnd.integers(1, 300)), 0).astype(np.int16)
        if trial % 3 == 0:
            s[:-1] = np.resize(s[: max(1, len(s) // 9)], len(s) - 1)
            s[:-1][s[:-1] == 0] = 1
        order = induced.suffix_array(s, int(s.max()) + 1)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        before, prefix = induced.permuted_prefixes(s, order)
        for i in range(len(s)):
            if (q := before[i]) >= 0:
                n = 0
                while max(i, q) + n < len(s) and s[i + n] == s[q + n]:
                    n += 1
                assert prefix[i] == n


def test_pieces_own_each_window_once():
    rnd = random.Random(1)
    texts = [prose(rnd, 400).encode(), b"a" * 900, b"short", prose(rnd, 60).encode()]
    text, start, size, *_ = suffix.pieces_of(texts)
    for i, t in enumerate(texts):
        windows = [w for s, n in zip(start[text == i], size[text == i]) for w in range(s, s + n - suffix.LENGTH + 1)]
        assert sorted(windows) == list(range(max(0, len(t) - suffix.LENGTH + 1)))


def sample():
    rnd = random.Random(5)
    rows = [r for r in edge_docs(rnd) if r[0] != 6]
    passage, other = prose(rnd, 60, seed=3), prose(rnd, 50, seed=4)
    for i in range(40):
        rows.append((100 + i, prose(rnd, 20 + i, seed=i) + passage + prose(rnd, 30, seed=99 + i), "en", "s", 0))
    rows.append((200, other + " x " + other + " y " + other[:250], "en", "s", 0))
    rows.append((201, "é" * 150 + "z", "en", "s", 0))
    rows.append((202, "q" + "é" * 150, "en", "s", 0))
    return rows


@pytest.mark.parametrize("group", [suffix.GROUP, 3])
def test_matches_brute_force(spark, group):
    rows = sample()
    got = suffix.remove_repeats(documents(spark, rows, clashing=True), group=group)
    want = [(str(r[0]), *b) for r, b in zip(rows, brute([r[1] for r in rows]))]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)


def test_texts_over_one_pass(spark, monkeypatch):
    rnd = random.Random(2)
    text = prose(rnd, 3000)
    copies = [text[100:9000] + "!" + text[:50], "start " + text]
    monkeypatch.setattr(suffix, "SLICE", 4096)
    suffix._powers.cache_clear()
    raw = [c.encode() for c in copies]
    text_, start, size, *_ = suffix.pieces_of(raw)
    for i, t in enumerate(raw):
        windows = [w for s, n in zip(start[text_ == i], size[text_ == i]) for w in range(s, s + n - suffix.LENGTH + 1)]
        assert sorted(windows) == list(range(len(t) - suffix.LENGTH + 1))
    suffix._powers.cache_clear()


def test_cut_texts_keep_columns(spark):
    rows = sample()
    docs = documents(spark, rows, clashing=True)
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    by_id = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by_id[1] is None and by_id[5] == "" and by_id[7] == "word"


def test_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
