"""Filter interaction audit over a sparse document-term matrix.

Texts are cut into slices of a few MB. A slice becomes a shard of the matrix in compressed
sparse row form, first over its own words; then all words of all shards are numbered once, in a
dictionary that Spark keeps distributed, and every shard is renumbered. No shard, dictionary
part or word list is larger than a slice, whatever the corpus.

Row sums and nonzero counts decide the filters on length and variety; the other flags travel
beside the rows. What is left is a count per part and set of failed filters, from which every
order of the filters is told.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.common import take, text_slices, texts_of
from wattline.session import spool

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PCT = 50
MAX_UPPER_PCT = 2
SYMBOLS = b"#$%&*|"
_ROW = 33  # bits that monotonically_increasing_id gives to a row within its partition

_UPPER = bytes(range(65, 91))
_TAILS = bytes(range(128, 192))  # bytes of a character after its first


def packed(values: np.ndarray) -> bytes:
    """Integers from 0 as bytes: the smallest width that holds them, its bytes in planes, compressed."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, kind.itemsize).T
    return bytes([kind.itemsize]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    """The integers of ``packed``, as int64."""
    width = data[0]
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"u{width}").ravel().astype(np.int64)


def counts_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, indptr, indices, data): the texts as rows of a matrix over their own words, which are sorted."""
    number: dict[bytes, int] = {}
    indptr, indices, data = np.zeros(len(texts) + 1, np.int64), [], []
    for i, text in enumerate(texts):
        found = Counter(text.split())
        indices.extend([number.setdefault(w, len(number)) for w in found])
        data.extend(found.values())
        indptr[i + 1] = len(indices)
    words = pa.array(number, pa.binary())
    order = pc.sort_indices(words)
    place = np.empty(len(words), np.int64)
    place[order.to_numpy()] = np.arange(len(words))
    return words.take(order), indptr, place[np.array(indices, np.int64)], np.array(data, np.int64)


def marks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(too many of A-Z, holds a symbol) of each text."""
    removed = lambda chars: np.array([len(t) - len(t.translate(None, chars)) for t in texts], np.int64)
    points = np.array([len(t) for t in texts], np.int64) - removed(_TAILS)
    return 100 * removed(_UPPER) > MAX_UPPER_PCT * points, removed(SYMBOLS) > 0


def _local_shards(rows: DataFrame) -> DataFrame:
    """A row per slice of (doc_id, part, text): its documents, its words, and its matrix over these words."""
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", T.ArrayType(kind)),
            T.StructField("part", T.ArrayType(T.StringType())),
            T.StructField("digest", T.ArrayType(T.BinaryType())),
            T.StructField("marks", T.BinaryType()),
            T.StructField("words", T.ArrayType(T.BinaryType())),
            *[T.StructField(c, T.BinaryType()) for c in ("indptr", "indices", "data")],
        ]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2):
            texts = [t or b"" for t in texts_of(batch.column(2))]
            words, *matrix = counts_of(texts)
            upper, symbol = marks_of(texts)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            digests = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    one(batch.column(0)), one(batch.column(1).cast(pa.string())), one(pa.array(digests, pa.binary())),
                    pa.array([(4 * upper + 8 * symbol).astype(np.uint8).tobytes()], pa.binary()), one(words),
                    *[pa.array([packed(x)], pa.binary()) for x in matrix],
                ],
                names=schema.names,
            )

    return rows.mapInArrow(build, schema)


def dictionary(words: DataFrame) -> DataFrame:
    """(word, id): the different values of column ``word``, numbered from 0 without gaps, in the order of their bytes.

    The numbers follow a stored sort: its parts are counted, one row each, and a word's number
    is its place in its part after the parts before.
    """
    different = spool(words.distinct(), "words")
    stored = spool(different.orderBy("word").withColumn("at", F.monotonically_increasing_id()), "dictionary")
    sizes = stored.groupBy(F.shiftright("at", _ROW).alias("of")).agg(F.count("*").alias("n")).orderBy("of").collect()
    before = np.cumsum([0, *[r["n"] for r in sizes]]).tolist()
    offsets = [(r["of"], b) for r, b in zip(sizes, before, strict=False)]
    known = stored.sparkSession.createDataFrame(offsets, "of bigint, before bigint")
    place = F.col("at").bitwiseAND(F.lit((1 << _ROW) - 1))
    return stored.join(F.broadcast(known), F.shiftright("at", _ROW) == F.col("of")).select("word", (F.col("before") + place).alias("id"))


def document_term_matrix(docs: DataFrame, doc_id: str = "doc_id", part: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(shards, dictionary) of the counts of every word in every document.

    A shard has lists doc_id, part (null: empty string) and digest, ``marks`` with a byte per
    document (4: too many of A-Z, 8: a symbol), and indptr, indices and data of its rows as
    ``packed`` integers; indices are the dictionary's numbers. The dictionary has word and id.
    A null text has no words. Repeated rows are rows of their own. A text longer than a slice
    is a shard alone. Without documents both are empty. Extra columns are ignored.
    """
    rows = take(docs, doc_id=doc_id, part=part, text=text).withColumn("part", F.coalesce(F.col("part").cast("string"), F.lit("")))
    local = spool(_local_shards(rows).withColumn("shard", F.monotonically_increasing_id()), "shards")
    asked = local.select("shard", F.explode("words").alias("word"))
    words = dictionary(asked.select("word"))
    # a shard's list has at most the words of a slice; sorted numbers are those of sorted words
    numbers = asked.join(words, "word").groupBy("shard").agg(F.collect_list("id").alias("ids"))
    both = local.drop("words").join(numbers, "shard", "left")
    kept = ["shard", "doc_id", "part", "digest", "marks", "indptr", "indices", "data"]
    both = both.select(*kept, "ids")
    schema = both.select(*kept).schema

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                by_place = np.sort(row.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                indices = packed(by_place[unpacked(row.column("indices")[0].as_py())])
                columns = [pa.array([indices], pa.binary()) if c == "indices" else row.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays(columns, names=kept)

    return both.mapInArrow(renumber, schema), words


def _judged(shards: DataFrame) -> DataFrame:
    """(doc_id, part, digest, failed) per document: the failed filters A to D as bits, A lowest."""
    schema = T.StructType(
        [
            T.StructField("doc_id", shards.schema["doc_id"].dataType.elementType),
            T.StructField("part", T.StringType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("failed", T.IntegerType()),
        ]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                indptr, data = (unpacked(row.column(c)[0].as_py()) for c in ("indptr", "data"))
                n = np.diff(np.concatenate(([0], np.cumsum(data)))[indptr])  # row sums
                distinct = np.diff(indptr)  # nonzero counts
                failed = np.frombuffer(row.column("marks")[0].as_py(), np.uint8).astype(np.int32)
                failed = failed + (n < MIN_WORDS) + 2 * (100 * distinct < MIN_DISTINCT_PCT * n)
                lists = [row.column(c).flatten() for c in ("doc_id", "part", "digest")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(failed.astype(np.int32))], names=schema.names)

    narrow = shards.select("doc_id", "part", "digest", "marks", "indptr", "data")
    return narrow.mapInArrow(judge, schema)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): counts by part and set of failed filters, E included."""
    # repeated rows become one, so that neither an id nor a text has more rows than it has variants
    rows = spool(rows.groupBy("doc_id", "part", "digest", "failed").agg(F.count("*").alias("n")), "audited")
    # only the first document of a text passes E; with the id in the key a text of many copies is no hot key
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    marks = take(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null and (quality = 1 or toxic = 1)")
    marks = marks.groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")])
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    both = rows.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    failed = F.col("failed") + F.when(copy, 16).otherwise(0)
    return both.groupBy("part", failed.alias("failed")).agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]
    )


def _steps(counts: DataFrame) -> DataFrame:
    """``counts`` once per order of the filters and step: filter_order, step, bit, before (the bits of earlier steps)."""
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    rows = counts.withColumn("filter_order", F.explode(orders))
    bits = F.expr("transform(sequence(1, 5), i -> shiftleft(1, ascii(substr(filter_order, i, 1)) - 65))")
    rows = rows.withColumn("bits", bits).select("*", F.posexplode("bits").alias("place", "bit"))
    before = F.expr("aggregate(slice(bits, 1, place), 0, (a, x) -> a | x)")
    return rows.withColumn("before", before).withColumn("step", (F.col("place") + 1).cast("int"))


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A row per part, order of the five filters and step, zeros included. Filters fail a document
    with under 200 words (A), with fewer different words than half its words (B), with more than
    2 % of A-Z (C), with one of ``#$%&*|`` (D), or with the text of a document of smaller id (E).
    A null text counts as empty, a null part as the empty string. A null id is no smaller id and
    never fails E. Repeated rows count as often as they occur. A document is good or toxic where
    any of its labels says so. Without documents there are no rows. Extra columns are ignored.
    """
    shards, _ = document_term_matrix(docs, doc_id, part, text)
    rows = _steps(_labelled(_judged(shards), labels))
    fails, earlier = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0))

    told = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))  # 600 rows a part
    return told.withColumn("shapley", shapley).drop("bit")
