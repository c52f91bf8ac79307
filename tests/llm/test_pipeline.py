"""The pipeline on a small table, and the queries that the driver sees."""

import random

from helpers import DOCS, documents, edge_docs, prose

import corpus_pipeline
from wattline.llm import queries
from wattline.session import spool


def sample():
    rnd = random.Random(21)
    rows = edge_docs(rnd) + [(100 + i, prose(rnd, 70 + i % 80, seed=i % 2), "en", "s", 0) for i in range(120)]
    copies = [(400 + i, rows[20][1], "en", f"c{i}", 0) for i in range(10)]
    passage = prose(rnd, 60, seed=8)
    shared = [(500 + i, prose(rnd, 120, seed=i) + " " + passage + " " + prose(rnd, 90, seed=40 + i), "en", "p", 0) for i in range(6)]
    return rows + copies + shared, passage


def test_every_stage_works_on_what_the_last_kept(spark, tmp_path):
    rows, passage = sample()
    documents(spark, rows, clashing=True).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(100 + i, i % 2, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, stored = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = spool(stage(spark, docs, str(tmp_path)), "stage")
        stored.append(docs)
    assert all(d.columns == columns for d in stored[:-1])
    good, one, cut, mixed = ({r["doc_id"]: r["text"] for r in d.collect()} for d in stored[:4])
    assert set(one) <= set(good) and set(cut) == set(one) == set(mixed)
    assert {1, 2, 3, 7} & set(good) == set()
    assert len(set(one) & {rows[20][0], *range(400, 410)}) == 1
    assert sum(passage in t for t in one.values()) >= 2 and not any(passage in t for t in cut.values())
    packed = stored[-1]
    total = sum(len((r["text"] or "").encode()) for r in stored[3].collect())
    assert packed.agg({"n_tokens": "sum"}).first()[0] == total
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_column_names_with_dots_and_back_ticks(spark, tmp_path):
    docs = documents(spark, sample()[0]).withColumnsRenamed({"n_chars": "n.chars"}).selectExpr("*", "source as `a``b.c d`")
    labels = [(100 + i, i % 2, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 0


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_query_of_each_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
