"""Small fixtures and brute-force versions for the training-data operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "row long, fp long, key string, tid long, n_words long, quality string, held_out string, block string"

_SYLLABLES = "an be con de er fi ga ho in ka lo mi nu or pe qua ri so tu ve wi xa yo ze".split()


def prose(rnd: random.Random, n: int, vocabulary: int = 300, seed: int = 0) -> str:
    words = ["".join(random.Random(seed * 10_007 + w).choices(_SYLLABLES, k=1 + w % 3)) for w in range(vocabulary)]
    out = []
    for i in range(n):
        w = words[min(int(rnd.expovariate(1 / 40)), vocabulary - 1)]
        out.append(w + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def edge_docs(rnd: random.Random) -> list[tuple]:
    """Nulls in every column, empty and long texts, repeated rows."""
    long_text = prose(rnd, 20_000)
    one = prose(rnd, 80)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, one, None, "b"), (4, one, None, "b"),
        (5, one, "en", "b"), (None, one, "en", None), (None, None, None, None), (6, long_text, "en", "a"), (7, "word", "en", "a"),
        (8, "ÀÉ ñ 中文 " * 30, "fr", "c"), (9, "%%% ### 123", "en", "c"), (10, "x" * 5000, "en", "c"), (11, "ab " * 400, "en", "c"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def documents(spark, rows, clashing: bool = False):
    df = spark.createDataFrame(rows, DOCS)
    if clashing:
        for column in CLASHING.split(", "):
            name, kind = column.split()
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df
