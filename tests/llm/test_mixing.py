import random

import numpy as np
import pytest
from helpers import DOCS, documents, edge_docs, prose
from pyspark.sql import functions as F

from wattline.llm import mixing

LABELS = "doc_id long, quality int, toxic int"


def sample():
    rnd = random.Random(6)
    rows, labels = edge_docs(rnd), [(1, None, None), (None, 1, 0), (4, 1, 0), (9, 0, 0), (9, 0, 0)]
    for i in range(150):
        kind = i % 3
        text = prose(rnd, 80)
        if kind == 1:
            text = " | ".join(text.split()) + " %%% ###"
        if kind == 2:
            text += " vile nasty " * 2
        rows.append((100 + i, text, "en", "s", 0))
        if i % 2:
            labels.append((100 + i, 0 if kind == 1 else 1, int(kind == 2)))
    return rows, labels


def test_rates_meet_the_targets(spark):
    rows, labels = sample()
    weights = {"good": 0.2, "poor": 0.5, "toxic": 0.3}
    got = mixing.mixing_rates(documents(spark, rows, clashing=True), spark.createDataFrame(labels, LABELS), weights).collect()
    assert len(got) == len(rows)
    post = np.array([[r["p_good"], r["p_poor"], r["p_toxic"]] for r in got])
    tokens = np.array([r["n_tokens"] for r in got], float)
    rate = np.array([r["rate"] for r in got])
    assert np.allclose(post.sum(axis=1), 1) and (rate >= 0).all()
    before, after = tokens @ post, (rate * tokens) @ post
    target = np.array([0.2, 0.5, 0.3]) * max(before / [0.2, 0.5, 0.3])
    assert np.allclose(after, target, rtol=1e-6)
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in got)
    kinds = {r["doc_id"]: int(np.argmax([r["p_good"], r["p_poor"], r["p_toxic"]])) for r in got}
    assert np.mean([kinds[100 + i] == i % 3 for i in range(150)]) > 0.95


def test_projection_keeps_rates_at_zero_or_above(spark):
    rnd = np.random.default_rng(2)
    p = rnd.dirichlet([0.3, 0.3, 0.3], 400)
    tokens = rnd.integers(1, 900, 400).astype(float)
    members = spark.createDataFrame([(float(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "tokens double, post array<double>")
    rate = mixing.fit_rates(members, {"good": 0.97, "poor": 0.02, "toxic": 0.01}, total=float(tokens.sum()))
    r = np.array([x[0] for x in members.select(rate).collect()])
    assert (r >= 0).all() and (r == 0).any()
    got = np.array([sum(a * b for a, b in zip(r * t_, c)) for t_, c in ((tokens, p[:, k]) for k in range(3))])
    want = np.array([0.97, 0.02, 0.01]) * tokens.sum()
    plain = np.ones(400)  # plain projected gradient in the same metric, many small steps
    for _ in range(20_000):
        plain = np.maximum(0, plain + 0.3 * p @ (want - (plain * tokens) @ p) / (tokens @ (p * p)).max())
    near = np.abs(((plain * tokens) @ p) - want).sum()
    assert np.abs(got - want).sum() <= near + 1e-6 * tokens.sum()


def test_copies_follow_the_rate(spark):
    df = spark.range(4000).select("id", mixing.copies_of(F.lit(2.25), F.col("id")).alias("n"))
    counts = [r["n"] for r in df.collect()]
    assert set(counts) == {2, 3} and abs(np.mean(counts) - 2.25) < 0.03


@pytest.mark.parametrize("labelled", [True, False])
def test_mix_repeats_whole_rows(spark, labelled):
    rows, labels = sample()
    docs = documents(spark, rows, clashing=True)
    out = mixing.mix(docs, spark.createDataFrame(labels if labelled else [], LABELS), least=1.0)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert set(ids) == {r[0] for r in rows} and len(ids) >= len(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert mixing.mixing_rates(empty, labels).collect() == [] and mixing.mix(empty, labels).collect() == []


def test_only_built_in_functions_run(spark):
    rows, labels = sample()
    plan = mixing.mixing_rates(documents(spark, rows), spark.createDataFrame(labels, LABELS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
