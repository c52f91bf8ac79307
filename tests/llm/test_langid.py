import random
import zlib

import numpy as np
from helpers import DOCS, documents, edge_docs, prose

from wattline.llm import langid


def sample():
    rnd = random.Random(12)
    rows = edge_docs(rnd)
    marks = {"en": "", "fr": "é", "de": "ß", "es": "ñ"}
    for i in range(400):
        lang = list(marks)[i % 4]
        words = prose(rnd, 6 + i % 70, seed=ord(lang[0])).split()
        rows.append((100 + i, " ".join(w + marks[lang] * (k % 4 == 0) for k, w in enumerate(words)), lang if i % 7 else None, "s", 0))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = sample()
    got = langid.identify(documents(spark, rows, clashing=True), per_language=60).collect()
    assert len(got) == len(rows)
    right = []
    for r in got:
        i = r["doc_id"]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if i is not None and i >= 100 and r["held_out"]:
            right.append(r["lang_pred"] == "en fr de es".split()[(i - 100) % 4])
    assert np.mean(right) > 0.95
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (1, 2, 3, 9))


def test_tables_give_the_filters_answers():
    net = langid.ByteNetwork.new(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    want = []
    for f in net.filters:
        n = langid.WINDOW - len(f) + 1
        want.append(sum(f[j][x[:, j : j + n]] for j in range(len(f))).max(axis=1))
    assert np.allclose(net.pooled(x, net.pair_tables()), np.concatenate(want, axis=1), atol=1e-5)


def test_whole_texts_are_read():
    net = langid.ByteNetwork.new(["a", "b"])
    text = bytes(random.Random(1).choices(range(97, 123), k=1000))
    cut = langid.windows(text)
    assert cut.tobytes()[: len(text)] == text and cut.shape == (4, langid.WINDOW)
    logs = net.log_softmax(net.pooled(cut, net.pair_tables()))
    mean = (logs * np.array([256, 256, 256, 232])[:, None]).sum(axis=0) / 1000
    want = np.exp(mean) / np.exp(mean).sum()
    label, score = net.predict([text], net.pair_tables())
    assert abs(score[0] - want.max()) < 1e-6 and label[0] == "ab"[want.argmax()]


def test_without_labels_or_rows(spark):
    docs = documents(spark, [(1, "some text", None, "s", 1)])
    assert [tuple(r)[2:] for r in langid.identify(docs).collect()] == [("und", 0.0)]
    assert langid.identify(spark.createDataFrame([], DOCS)).collect() == []
