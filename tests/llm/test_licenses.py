import random
import textwrap

from helpers import DOCS, documents, edge_docs, prose

from wattline.llm import licenses


def sample():
    rnd = random.Random(2)
    rows = edge_docs(rnd)
    mit = licenses.TEXTS["MIT"]
    rows += [
        (100, mit, "en", "s", 0),
        (101, "Copyright (c) 2019 Someone Else\n(C) 2020 others\n\n" + mit.upper().replace(",", " ;"), "en", "s", 0),
        (102, mit.replace("sublicense", "sublicence"), "en", "s", 0),
        (103, mit + " and more", "en", "s", 0),
        (104, prose(rnd, 30) + "\nReleased under the MIT licence\nlicensed under CC BY-NC 4.0.\nReleased under the MIT License.", "en", "s", 0),
        (105, licenses.TEXTS["ISC"].replace("\n", "  "), "en", "s", 0),
        (106, "Released under the MIT License.", "en", "s", 0),
    ]
    return rows


def test_texts_and_lines_are_found(spark):
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, sample(), clashing=True)).collect() if (r["doc_id"] or 0) >= 100}
    assert [got[i]["license_id"] for i in range(100, 107)] == ["MIT", "MIT", "MIT", None, None, "ISC", "MIT"]
    assert (got[104]["n_license_lines"], got[104]["line_license_ids"]) == (3, "CC-BY-NC-4.0,MIT")
    assert (got[106]["n_license_lines"], got[100]["n_license_lines"]) == (1, 0)


def test_edges_and_repeats(spark):
    rows = sample()
    got = licenses.scan(documents(spark, rows, clashing=True)).collect()
    assert len(got) == len(rows)
    empty = {r["text_digest"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1 and all(r["license_id"] is None for r in got if r["doc_id"] in (1, 2, 3))


def test_own_table_of_licenses(spark):
    known = spark.createDataFrame([("A", "My Licence, one."), ("B", "my license ONE"), (None, "x"), ("C", "..."), ("D", None)], "license_id string, text string")
    docs = spark.createDataFrame([(1, "my license: one"), (2, "...")], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in licenses.scan(docs, known).collect()} == {1: "A", 2: None}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    none = spark.createDataFrame([], "license_id string, text string")
    assert licenses.scan(empty).collect() == []
    assert [r["license_id"] for r in licenses.scan(documents(spark, sample()[:3]), none).collect()] == [None] * 3


def test_titles_holders_and_line_breaks_do_not_matter(spark):
    rows, want = [], {}
    for kind, text in licenses.TEXTS.items():
        whole = " ".join(text.split())
        for width in range(50, 121):
            wrapped = "\n".join(textwrap.wrap(whole, width, break_on_hyphens=False))
            title = random.Random(width).choice(["", *licenses.TITLES[kind]])
            holder = random.Random(-width).choice(["", "Copyright (c) 2020 Some One", "Copyright 1999-2004, X and others", "(C) by Y", "Copyright (c) Z"])
            lines = "\n".join(x for x in (title, holder, wrapped) if x)
            if width % 3 == 0:
                lines = "\n".join("# " + x for x in lines.split("\n"))
            want[len(rows)] = kind
            rows.append((len(rows), lines))
    rows.append((len(rows), licenses.TEXTS["MIT"] + "\n(c) You must retain all notices."))  # a clause, not a holder
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["license_id"] for r in got} == {**want, len(rows) - 1: None}
