"""Licence scans: canonical digests of whole texts and lines, joined to those of known licences.

Everything is built-in SQL functions. A text is lower-cased, its copyright lines go, spellings
that licences treat as equal are made one, punctuation and white space become single spaces,
and the SHA-256 of the rest is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import take
from wattline.session import spool

# Short notices and public licence texts with their SPDX identifiers.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "MIT": ["Released under the MIT License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3."],
}
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
}
# Title lines that stand above these texts.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
}
# Spellings and words that count as equal, applied in this order.
EQUAL = (
    ("licence", "license"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("noncommercial", "non commercial"),
    ("https", "http"),
)
# A line, perhaps a comment, that opens with a copyright mark before a year, "by" or a second mark; a clause
# that a line break happens to begin with "copyright" or "(c)" is none.
COPYRIGHT = r"(^|\n)[ \t#*/;%-]*(copyright[ \t]*(\(c\)|©)|(copyright|\(c\)|©)[ \t]*:?[ \t]*(by[ \t]|[0-9]{4}))[^\n]*"


def canonical(text: Column) -> Column:
    """The normal form of a text; empty for a null one."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "$1")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    for a, b in EQUAL:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def shipped() -> list[tuple[str, str]]:
    """(license_id, text) of the notices and texts, these with and without a title."""
    titled = [(k, f"{title}\n\n{TEXTS[k]}") for k, titles in TITLES.items() for title in titles]
    return [*((k, t) for k, texts in NOTICES.items() for t in texts), *TEXTS.items(), *titled]


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the licences and notices that ship with the operator."""
    return spark.createDataFrame(shipped(), "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_digest, license_id, n_license_lines, line_license_ids; one row per row of ``docs``.

    ``license_id`` is the licence whose whole text the document is; ``line_license_ids`` lists,
    sorted and joined by commas, the licences of which the document has a line, and
    ``n_license_lines`` counts its lines that are known. Of several licences with one digest the
    least name counts. A null or empty text has the digest of an empty one, which is never a
    licence. The join is an equality join on digests; the known side has one row per digest and
    Spark broadcasts it only while it is small. Lines whose normal form is as long as no known
    one can't match and are not digested. Extra columns are ignored.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    table = take(known, license_id="license_id", text="text").where(F.col("license_id").isNotNull() & (canonical(F.col("text")) != ""))
    table = table.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"), F.min(F.length(canonical(F.col("text")))).alias("size"))
    table = spool(table, "known-licenses")
    named = table.select("digest", "license_id")
    sizes = [r["size"] for r in table.select("size").distinct().collect()]
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    near = F.filter(lines, lambda x: F.length(canonical(x)).isin(*sizes)) if sizes else F.array().cast("array<string>")
    rows = take(docs, doc_id=doc_id, text=text).select(
        "doc_id", digest(F.col("text")).alias("text_digest"), F.transform(near, digest).alias("line_digests"), F.monotonically_increasing_id().alias("row")
    )
    rows = spool(rows, "license-digests")
    hits = rows.select("row", F.explode("line_digests").alias("digest")).join(named, "digest")
    hits = hits.groupBy("row", "license_id").agg(F.count("*").alias("n")).groupBy("row").agg(
        F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("ids")
    )
    whole = rows.join(named, rows["text_digest"] == named["digest"], "left")
    return whole.join(hits, "row", "left").select(
        "doc_id", "text_digest", "license_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_license_lines"), F.coalesce("ids", F.lit("")).alias("line_license_ids")
    )
